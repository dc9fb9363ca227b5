"""Conversation repair and the prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from deskloom.llm import prefix_trie, repair

SCHEMA = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType())]
    # Further columns that the operators use themselves.
    + [T.StructField(n, T.StringType()) for n in ("role", "text", "seen", "gone", "path", "digest", "id")]
)


@pytest.fixture(scope="module")
def turns(spark):
    def make(rows, parts=3):
        frame = spark.createDataFrame([(*r, "x", "y", "z", "d", "i") for r in rows], SCHEMA)
        return frame.repartition(parts) if rows else frame

    return make


def rows_at_random(seed, convs=60):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "why", "", " \n", "Where is it?", None, "日本 ☃", "x" * 40 + "."]
    out = []
    for c in range(convs):
        for t in range(rnd.choice([0, 1, 2, 3, 4, 5, 6, 9, 30])):
            turn = rnd.choice([t, t, t, t + 1, None])
            out.append((c - 5, turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice(texts)))
    return out


# --- repair -----------------------------------------------------------------------


def cheapest(codes):
    """Cost and least edits by dynamic programming."""

    def with_inserts(ways):
        for _ in range(3):
            for state, (cost, edits) in list(ways.items()):
                to, way = repair.TURN[state], (cost + 3, edits + "I")
                ways[to] = min(ways.get(to, way), way)
        return ways

    ways = {0: (0, "")}
    for code in codes:
        longer = {}
        for state, (cost, edits) in with_inserts(ways).items():
            options = [(state, cost + 4, "D")]
            if not code & repair.BAD:
                stay = 3 if code & repair.SHORT else 0
                options.append((repair.TURN[state], cost + 3 + stay, "R"))
                if (to := repair.NEXT[state][code & 3]) is not None:
                    options.append((to, cost + stay, "K"))
            for to, c, sign in options:
                longer[to] = min(longer.get(to, (c, edits + sign)), (c, edits + sign))
        ways = longer
    return min(w for state, w in with_inserts(ways).items() if state in repair.FINAL)


def codes_at_random(rnd, n):
    return bytes(rnd.choice([0, 1, 1, 2, 2, 3]) | rnd.choice([0, 0, 0, 4, 8, 8]) for _ in range(n))


def test_search_finds_the_least_of_the_cheapest_edits():
    rnd = random.Random(3)
    for _ in range(800):
        codes = codes_at_random(rnd, rnd.randrange(0, 15))
        assert repair.cheapest_edits(codes) == cheapest(codes), codes


def test_segments_change_nothing(monkeypatch):
    rnd = random.Random(4)
    for segment, pattern in ((3, 2), (5, 8), (16, 8), (7, 3)):
        monkeypatch.setattr(repair, "SEGMENT", segment)
        monkeypatch.setattr(repair, "PATTERN", pattern)
        for _ in range(60):
            codes = codes_at_random(rnd, rnd.randrange(0, 40))
            assert repair.cheapest_edits(codes) == cheapest(codes), (segment, codes)


def plain_repair(rows):
    """Damage, faults and repair of (conv_id, turn, role, text) rows, one conversation after the other."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = convs[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn is not None, turn or 0, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort()
        numbers = [t for known, t, _, _ in kept if known]
        seen, codes, counts = set(), [], [0, 0, 0]
        for _, _, role, text in kept:
            bare = text.strip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            codes.append(repair.ROLES.get(role[:1], 3) | (0 if fault is None else 4 if fault < 2 else 8))
        firsts = [r[:1] for _, _, r, _ in kept]
        cost, audit = cheapest(codes)
        lines, state, rest = [], 0, iter(kept)
        for edit in audit:
            _, _, role, text = (None, None, None, "") if edit == "I" else next(rest)
            if edit == "D":
                continue
            if edit == "K":
                state = repair.NEXT[state][repair.ROLES[role[:1]]]
            else:
                state = repair.TURN[state]
                role = "user" if state == 2 else "assistant"
            lines.append(f"{role}:{text}")
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *counts,
            sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def figures(frame):
    rows = repair.repair_figures(repair.damaged(frame), gone="gone").collect()
    found = {r[0]: tuple(r[1:]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_of_damaged_conversations(turns, seed, monkeypatch):
    rows = rows_at_random(seed) + [(None, 1, "user", "lost?"), (None, None, None, None)]
    assert figures(turns(rows)) == plain_repair(rows)


def test_repair_of_long_and_spilled_conversations(turns, monkeypatch):
    monkeypatch.setattr(repair, "IN_MEMORY", 100)
    rnd = random.Random(9)
    rows = [(1, t, rnd.choice(["user", "assistant"]), f"text {t} " + "é" * (t % 50) + rnd.choice(".!? ")) for t in range(300)]
    assert figures(turns(rows)) == plain_repair(rows)


def test_all_rows_dropped_and_empty_table(turns):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert figures(turns([(gone, 0, "user", "Hi.")])) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert figures(turns([])) == {}


def test_repaired_turns_read_as_the_grammar_wants(turns):
    import re

    rows = rows_at_random(5)
    out = repair.repaired_turns(turns(rows)).collect()
    convs = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.conv_id, r.position)):
        convs[r.conv_id].append(r.role[:1])
    assert convs and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in convs.values())


# --- trie -------------------------------------------------------------------------


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).digest()
            convs[conv].append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(convs.get(lender, [])[:h] + own[h:])
    nodes, children = defaultdict(set), defaultdict(set)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].add(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        own = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own + sum(saved[k] for k in children[path])
    return sorted(
        (
            min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest(),
        )
        for p, m in nodes.items()
    )


def trie(frame):
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie.trie_nodes(frame).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_rebuilt_conversations(turns, seed):
    rows = rows_at_random(seed) + [(None, 1, "user", "lost")]
    assert trie(turns(rows)) == plain_trie(rows)


def test_trie_over_many_shards_and_rounds(turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_BYTES", 100)
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    rnd = random.Random(8)
    # Few different turns, copies and beginnings of one another, so that many nodes lie on borders.
    rows = [(c, t, "user", "ab"[rnd.randrange(2)]) for c in range(80) for t in range(rnd.randrange(7))]
    rows += [(c, t, "user", "a") for c in range(100, 140) for t in range(5)]
    assert trie(turns(rows)) == plain_trie(rows)


def test_trie_of_odd_tables(turns):
    assert trie(turns([])) == []
    rows = [(7, 0, "user", "own turn that the lent ones replace")]
    assert trie(turns(rows)) == plain_trie(rows)
    rows = [(5, t, "user", f"t{t}") for t in range(400)] + [(6, 0, None, None)] * 3
    assert trie(turns(rows)) == plain_trie(rows)
