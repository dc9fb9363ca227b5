"""Canonicalisers: keys, aliases, channels, intents, urgencies, booleans, routes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from deskloom import lexicon as lx
from deskloom.functions.text import bind, let, sql_array, sql_list, strip


def canonical_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def _canon(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isascii() and ch.isalnum())


def pick(record: Column, aliases, *, empty=("", "[]", "{}")) -> Column:
    """First entry in record order whose key is an accepted alias and whose value is not empty."""
    wanted = sql_list(sorted({_canon(a) for a in aliases}))
    test = F.expr(
        f"e -> regexp_replace(lower(e.key), '[^a-z0-9]', '') IN ({wanted}) "
        f"AND e.value NOT IN ({sql_list(empty)})"
    )
    hits = F.call_function("filter", F.map_entries(record), test)
    return F.get(hits, F.lit(0))["value"]


def label(labels: Column, extra: Column, name: str) -> Column:
    """Gold label under any accepted name: labels block first, then unmapped fields.

    Only underscores are ignored in keys, and an empty value that comes first wins.
    """
    wanted = sql_list(sorted({a.lower().replace("_", "") for a in lx.LABEL_ALIASES[name]}))
    test = f"e -> replace(lower(e.key), '_', '') IN ({wanted})"
    return bind(
        f"nvl(get(filter(map_entries(x.labels), {test}), 0), get(filter(map_entries(x.extra), {test}), 0)).value",
        labels=labels, extra=extra,
    )


def channel(value: Column) -> Column:
    """struct(channel, warning) for a raw channel name."""
    by_channel: dict[str, set[str]] = {}
    for name, target in lx.CHANNEL_NAMES:
        by_channel.setdefault(target, set()).add(_canon(name))
    key = "regexp_replace(lower(x.v), '[^a-z0-9]', '')"
    exact = "CASE " + " ".join(
        f"WHEN {key} IN ({sql_list(sorted(names))}) THEN '{t}'" for t, names in by_channel.items()
    ) + " END"
    loose = "CASE " + " ".join(
        f"WHEN contains(lower(x.v), '{name}') THEN '{t}'" for name, t in lx.CHANNEL_NAMES
    ) + " END"
    found = let(bind(f"struct({exact} AS exact, {loose} AS loose, x.v AS v)", v=value), lambda c: c)
    return F.struct(
        F.coalesce(found["exact"], found["loose"], F.lit("unknown")).alias("channel"),
        bind(
            f"CASE WHEN x.v IS NULL THEN '{lx.WARN_NO_CHANNEL}' WHEN x.exact IS NOT NULL THEN NULL "
            "WHEN x.loose IS NOT NULL THEN concat('channel \\'', x.v, '\\' matched loosely to ', x.loose) "
            "ELSE concat('channel \\'', x.v, '\\' not recognised; treated as unknown') END",
            v=found["v"], exact=found["exact"], loose=found["loose"],
        ).alias("warning"),
    )


def latency_budget(channel_name: Column) -> Column:
    budget = F.lit(lx.DEFAULT_LATENCY_BUDGET)
    for name, seconds in lx.LATENCY_BUDGET_SECONDS.items():
        budget = F.when(channel_name == name, F.lit(seconds)).otherwise(budget)
    return budget


def as_bool(value: Column) -> Column:
    def read(word: Column) -> Column:
        return F.when(word.isin(*lx.TRUE_WORDS), F.lit(True)).when(
            word.isin(*lx.FALSE_WORDS), F.lit(False)
        )

    return let(F.lower(strip(value)), read)


def expected_escalation(value: Column) -> Column:
    """Whether a route label means that a person sees the ticket."""
    def read(word: Column) -> Column:
        return F.when(word.rlike("|".join(lx.ESCALATE_WORDS)), F.lit(True)).when(
            word.rlike("|".join(lx.AUTOMATE_WORDS)), F.lit(False)
        )

    return let(F.lower(strip(value)), read)


def default_intent(taxonomy=lx.TAXONOMY) -> str:
    return "other" if "other" in taxonomy else taxonomy[0]


def canonical_intent(value: Column, taxonomy=lx.TAXONOMY) -> Column:
    """Exact, then ignoring underscores, then prefix (shortest), then containment (longest)."""
    # Candidates in preference order, so that the first hit is the winner.
    names = sql_array(taxonomy)
    shortest = sql_array(sorted(taxonomy, key=len))
    longest = sql_array(sorted(taxonomy, key=lambda n: -len(n)))
    return bind(
        f"""coalesce(
          get(filter({names}, n -> n = x.raw), 0),
          get(filter({names}, n -> replace(n, '_', '') = replace(x.raw, '_', '')), 0),
          get(filter({shortest}, n -> startswith(n, x.raw) OR startswith(x.raw, n)), 0),
          get(filter({longest}, n -> contains(n, x.raw) OR contains(x.raw, n)), 0),
          '{default_intent(taxonomy)}')""",
        raw=F.translate(F.lower(strip(value)), " -", "__"),
    )


def canonical_urgency(value: Column) -> Column:
    known = {level: level for level in lx.URGENCIES} | lx.URGENCY_SYNONYMS
    table = sql_list(x for pair in known.items() for x in pair)
    return bind(f"coalesce(map({table})[x.word], 'medium')", word=F.lower(strip(value)))
