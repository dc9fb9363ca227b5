"""Personal data in texts, and terms that give the persons away.

Fixed patterns give the protected entities (base spans). How strongly a term reveals an entity is
estimated from the whole corpus: the pointwise mutual information of the two over documents, as a
share of the entity's own information, 1 when the term occurs with nothing else. A term counts
wherever it stands in a document. Small counts are corrected by chance: a pair is left out when
documents without any tie would share that much with a probability of 1 / documents or more, which
one common document never falls below. Terms above ``REMOVE`` are removed, those above ``GENERALISE``
are generalised, wherever they stand in the documents of that entity; both become spans.

A first pass finds entities and the distinct terms of their documents, a second counts those terms
in all documents, with a bitmap of fixed size to leave out other words and sums in the task before
the shuffle, a third brings the places of the terms that reveal.

Spans are code points, end exclusive. Null text: empty, no spans. Ids may be null or repeat; each row
is one document of the counts. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from deskloom.llm.common import admits, kept, key_filter, pick, text_buffers, text_slices
from deskloom.llm.hashing import TERMS, words

KINDS = ("email", "ip", "card", "phone")
ADDED = ("remove", "generalise")
#: Words to either side of an entity that count: the whole document.
NEAR = 1 << 40
#: Documents that a pair needs at all; one document alone never passes the correction.
SUPPORT = 2
REMOVE, GENERALISE = 0.95, 0.8
#: Bytes of the shortest term.
LEAST = 2

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start only: a later start meets the same end.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: What tells that a text can have a base span, for a linear scan of whole Arrow columns.
HINT = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){15}|\+[0-9][ ().0-9-]+[0-9]"

FOUND = "entities array<bigint>, terms array<bigint>"
PLACED = (
    "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "places array<struct<entity:bigint,term:bigint,start:bigint,end:bigint>>"
)
#: A pair as one key, alike here and in SQL.
PAIR = "entity ^ term ^ shiftleft(term, 19)"
#: Parts of each key of the joins.
SALTS = 16


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = end = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at)):
            yield start, (end := domain.end())
            at = end
        else:
            at += 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Fixed patterns by kind, then start; failing matches dropped, without another try."""
    found = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m.group()))
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


def _entity(kind: str, value: str) -> int:
    """Number of an entity, the same however it is spaced or cased."""
    bare = value.lower() if kind in ("email", "ip") else "".join(_DIGITS.findall(value))
    return int.from_bytes(hashlib.blake2b(f"{kind}:{bare}".encode(), digest_size=8).digest(), "little", signed=True)


def _terms(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the terms of a text; none that belongs to an entity."""
    raw = np.frombuffer(text.encode(), np.uint8)
    hashes, _, first, last = words(raw, np.array([0, len(raw)]), TERMS)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    starts, ends = points[first], points[last]
    letters = np.add.reduceat(np.append((raw >= 0x41) & ~((raw >= 0x5B) & (raw <= 0x60)), 0).astype(np.int64), first) if len(first) else first
    fit = (last - first >= LEAST) & (letters > 0)
    for _, a, b in spans:
        # Words are in order, so those that meet a span are neighbours.
        fit[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = False
    return hashes[fit], starts[fit], ends[fit]


def _entities(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    return sorted({_entity(kind, text[a:b]) for kind, a, b in spans})


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hinted(texts: pa.Array) -> Iterator[tuple[int, str, list[tuple[str, int, int]]]]:
    """Row, text and base spans of the texts that have some."""
    for row in np.flatnonzero(pc.match_substring_regex(texts, HINT).fill_null(False).to_numpy(False)).tolist():
        text = texts[row].as_py()
        if spans := base_spans(text):
            yield row, text, spans


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct entities and terms of the documents with entities."""
    kind = pa.list_(pa.int64())
    for batch in batches:
        for _, text, spans in _hinted(batch.column("text")):
            terms = np.unique(_terms(text, spans)[0]).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"entities": pa.array([_entities(text, spans)], kind), "terms": pa.array([terms], kind)}
            )


def _place(bits):
    """Base spans of every row, and the places of terms whose pair with an entity the filter admits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("entity", "term", "start", "end")]))
        for batch in batches:
            n = batch.num_rows
            counts = {k: np.zeros(n, np.int64) for k in KINDS}
            digests, base, places = [nothing] * n, [""] * n, [[] for _ in range(n)]
            for row, text, spans in _hinted(batch.column("text")):
                for k, *_ in spans:
                    counts[k][row] += 1
                base[row] = joined(spans)
                digests[row] = hashlib.sha256(base[row].encode()).hexdigest()
                terms, starts, ends = _terms(text, spans)
                for entity in _entities(text, spans):
                    key = np.array([entity], np.int64).view(np.uint64) ^ terms ^ (terms << np.uint64(19))
                    places[row] += [
                        {"entity": entity, "term": t, "start": a, "end": b}
                        for i in [np.flatnonzero(admits(bits.value, key))]
                        for t, a, b in zip(terms[i].view(np.int64).tolist(), starts[i].tolist(), ends[i].tolist())
                    ]
            yield pa.RecordBatch.from_pydict(
                {"row": batch.column("row"), "doc_id": batch.column("doc_id")}
                | {f"n_{k}": pa.array(counts[k]) for k in KINDS}
                | {"base_sha256": pa.array(digests), "base": pa.array(base), "places": pa.array(places, kind)}
            )

    return run


def _term_counts(bits):
    """Documents of each admitted term, summed within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            found = []
            for a, b in text_slices(batch, "text"):
                hashes, group, _, _ = words(data, offsets[a : b + 1], TERMS)
                hit = admits(bits.value, hashes)
                hashes, group = hashes[hit], group[hit]
                order = np.lexsort((hashes, group))
                hashes, group = hashes[order], group[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (group[1:] != group[:-1])
                found.append(hashes[new])
            terms, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return run


def disclosures(found: DataFrame, texts: DataFrame) -> DataFrame:
    """entity, term, share (0 to 1) of the pairs whose share reaches ``GENERALISE``."""
    context = texts.sparkSession.sparkContext
    # Within a row a pair counts once, so counts are documents; without a term it is the entity's own.
    every = found.select(F.explode("entities").alias("entity"), F.concat("terms", F.array(F.lit(None).cast("long"))).alias("terms"))
    pairs = every.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("both"))
    pairs = kept(pairs.filter(F.col("term").isNull() | (F.col("both") >= SUPPORT)), "pairs")
    supported = pairs.filter(F.col("term").isNotNull())
    entities = pairs.filter(F.col("term").isNull()).select("entity", F.col("both").alias("n_entity"))
    terms = supported.select("term").distinct()
    bits = context.broadcast(key_filter(terms.select(F.col("term").alias("key"))))
    counted = texts.mapInArrow(_term_counts(bits), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    total = texts.agg(F.count("*").alias("n"))
    # A common term or entity is dealt out by the other of the two.
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
    by_term = supported.withColumn("salt", F.pmod(F.xxhash64("entity"), F.lit(SALTS)).cast("int")).join(
        counted.withColumn("salt", salts), ["term", "salt"]
    )
    by_both = by_term.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(
        entities.withColumn("salt", salts), ["entity", "salt"]
    )
    # p(t, e) / (p(t) p(e)) in documents, and the entity's information -log p(e).
    mutual = F.log(F.col("both") * F.col("n") / (F.col("n_term") * F.col("n_entity")))
    own = F.log(F.col("n") / F.col("n_entity"))
    # So many of the term's documents have the entity by chance: C(n_term, both) ways at most, each with
    # p(e) ** both; the number of ways is bounded by the entropy of the choice.
    rest = F.col("n_term") - F.col("both")
    ways = (
        F.col("n_term") * F.log("n_term") - F.col("both") * F.log("both")
        - F.when(rest > 0, rest * F.log(rest)).otherwise(F.lit(0.0))
    )
    return (
        by_both.join(F.broadcast(total))
        .withColumn("share", F.when(own > 0, mutual / own).otherwise(F.lit(0.0)))
        .filter((F.col("share") >= GENERALISE) & (ways - F.col("both") * own < -F.log("n")))
        .select("entity", "term", "share")
    )


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return pick(docs, doc_id=doc_id, text=text).withColumn("row", F.monotonically_increasing_id())


def private_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_remove, n_generalise for each row."""
    own = pick(docs, doc_id=doc_id, text=text)
    rows = _rows(docs, doc_id, text)
    revealing = kept(disclosures(rows.mapInArrow(_find, FOUND), own.select("text")), "revealing")
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(revealing.select(F.expr(PAIR).alias("key"))))
    found = kept(rows.mapInArrow(_place(bits), PLACED), "private")
    places = found.select("row", F.explode("places").alias("x")).select("row", "x.*").join(revealing, ["entity", "term"])
    strongest = places.groupBy("row", "start", "end").agg(F.max("share").alias("share"))
    action = F.when(F.col("share") >= REMOVE, F.lit(0)).otherwise(F.lit(1))
    added = strongest.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct(action.alias("kind"), "start", "end"))).alias("added")
    )
    name = F.array(*[F.lit(k) for k in ADDED])
    text_of = F.array_join(
        F.transform("added", lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ","
    )

    def n_of(kind: int):
        return F.coalesce(F.size(F.filter("added", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")

    both = found.drop("places").join(added, "row", "left")
    return both.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), text_of).alias("spans"),
        F.when(F.col("added").isNull(), F.lit(0).cast("long")).otherwise(n_of(0)).alias("n_remove"),
        F.when(F.col("added").isNull(), F.lit(0).cast("long")).otherwise(n_of(1)).alias("n_generalise"),
    )


def sanitise(text: str, spans: str) -> str:
    """The text with entities and generalised terms as their kind in brackets and removed terms gone."""
    parts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, kind in parts:
        if a < at:  # lies within an earlier span
            at = max(at, b)
            continue
        out += [text[at:a], "" if kind == "remove" else "[term]" if kind == "generalise" else f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])
