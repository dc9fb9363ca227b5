"""Prefix trie of conversations: how many share each beginning, and what storing it once saves.

A node is a distinct sequence of first turns (role, text); the root has none. Conversations are
rebuilt first: ``conv_id - conv_id % 5`` lends its first ``crc32(conv_id) % 9`` turns, the
conversation's own turns after as many follow.

* Turns become 16-byte digests where they are read; texts are never shuffled. One exchange by the
  lending family brings a family's turns together in order, and they stream through, so that a task
  holds one conversation's path (20 bytes a turn).
* Equal paths are merged before they move on. Distinct paths are dealt out by ranges of their own
  order. In each shard the turn ids are dictionary-encoded (by rank among the shard's digests) and
  put into ternary search trees, one a trie level, balanced by inserting medians first; an explicit
  stack walks the tree and accumulates members, leaves and savings.
* A node that begins a shard's first or last path may go on in the neighbour shard. Such boundary
  nodes (two paths a shard) are merged in rounds of ``FAN`` neighbours, each round keeping only what
  still borders on the next group. Nodes below learn a boundary parent's smallest member by a join
  with that small table.
* Hashes of the conversations that end in a node stream through sorted ids.

Order: by turn, nulls first; equal turns by digest. Null role or text: empty. Rows without a
conversation id are left out. Repeated rows are turns of their own. Empty table: no rows. Further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deskloom.llm.common import kept

DIGEST = 16
#: Turns that a conversation may take over, and the size of a family that shares its first member's.
MOST_SHARED, FAMILY = 8, 5
#: Bytes of paths in a shard, about; neighbouring shards that one merge takes.
SHARD_BYTES, FAN = 8 << 20, 32
#: Boundary nodes up to which they are sent to all tasks.
BROADCAST_NODES = 100_000
BATCH = 8192
EMPTY = hashlib.sha256(b"").hexdigest()

PATH = "conv_id long, path binary, sizes binary"
#: A node as far as one shard or group knows it. ``inner_*``: of its children that are settled.
NODE = (
    "id binary, parent binary, depth long, size long, first_conv long, parent_conv long, n_convs long, "
    "n_children long, n_leaves long, saved long, border boolean, shard long"
)
NAMES = tuple(part.split()[0] for part in NODE.split(", "))


def _shared_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % (MOST_SHARED + 1)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by family, lender first, conversation and turn -> one path for each conversation."""
    out: list[tuple[int, bytes, bytes]] = []
    held = 0
    family = conv = None
    lent: list[tuple[bytes, int]] = []
    path, sizes, skip = bytearray(), [], 0

    def close() -> pa.RecordBatch:
        ids, paths, sized = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_pydict(
            {"conv_id": pa.array(ids, pa.int64()), "path": pa.array(paths, pa.binary()), "sizes": pa.array(sized, pa.binary())}
        )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("family", "conv_id", "digest", "size")]
        for of, conv_id, digest, size in zip(*columns, strict=True):
            if conv_id != conv:
                if conv is not None:
                    out.append((conv, bytes(path), np.array(sizes, "<u4").tobytes()))
                    held += len(path)
                    if held > 1 << 22 or len(out) >= BATCH:
                        yield close()
                        out, held = [], 0
                if of != family:
                    family, lent = of, []
                conv, lender = conv_id, conv_id == of
                skip = 0 if lender else _shared_turns(conv_id)
                path, sizes = bytearray(b"".join(d for d, _ in lent[:skip])), [s for _, s in lent[:skip]]
            if lender and len(lent) < MOST_SHARED:
                lent.append((digest, size))
            if skip:
                skip -= 1
                continue
            path += digest
            sizes.append(size)
    if conv is not None:
        out.append((conv, bytes(path), np.array(sizes, "<u4").tobytes()))
    yield close()


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """conv_id, path (digests of the rebuilt turns), sizes (UTF-8 bytes of their texts)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    own = turns.filter("conv_id is not null").select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        # The length tells where the role ends.
        F.unhex(F.md5(F.concat_ws(":", F.octet_length(role), role, text))).alias("digest"),
        F.octet_length(text).alias("size"),
    )
    return (
        own.repartition("family")
        .sortWithinPartitions("family", F.col("family") != F.col("conv_id"), "conv_id", F.asc_nulls_first("turn"), "digest")
        .drop("turn")
        .mapInArrow(_paths, PATH)
    )


class _TernaryTree:
    """Sequences of turn ids: nodes in parallel lists, each with smaller, equal (next turn) and larger links."""

    def __init__(self):
        self.key: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.down: list[int] = []  # tree of the next turn
        self.path: list[int] = []  # a path through the node

    def _new(self, key: int, path: int) -> int:
        self.key.append(key)
        self.path.append(path)
        for links in (self.low, self.high, self.down):
            links.append(-1)
        return len(self.key) - 1

    def insert(self, turns: np.ndarray, path: int) -> None:
        if not self.key:
            self._new(-1, path)  # the root, above all first turns
        before, links = 0, self.down
        for key in turns.tolist():
            at = links[before]
            while at >= 0 and self.key[at] != key:
                links, before = (self.low if key < self.key[at] else self.high), at
                at = links[before]
            if at < 0:
                at = self._new(key, path)
                links[before] = at
            links, before = self.down, at

    def children(self, node: int) -> list[int]:
        """Nodes of the next turn, in order."""
        out, stack, at = [], [], self.down[node]
        while stack or at >= 0:
            while at >= 0:
                stack.append(at)
                at = self.low[at]
            at = stack.pop()
            out.append(at)
            at = self.high[at]
        return out


def _medians(n: int) -> Iterator[int]:
    """0 .. n-1, the middle first, then the middles of both halves and so on."""
    ranges = [(0, n)]
    for a, b in ranges:  # grows while it is read
        if a < b:
            middle = (a + b) // 2
            yield middle
            ranges += ((a, middle), (middle + 1, b))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), *(pa.int64(),) * 8, pa.bool_(), pa.int64())
    columns = zip(*rows) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(NAMES))


def _node_ids(path: bytes) -> list[bytes]:
    """Id of each beginning of a path, the root's first: the digest of the digests."""
    digest, out = hashlib.md5(), [hashlib.md5().digest()]
    for a in range(0, len(path), DIGEST):
        digest.update(path[a : a + DIGEST])
        out.append(digest.digest())
    return out


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's distinct paths in order -> its nodes; those that neighbours may share are marked."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    paths: list[bytes] = []
    sizes: list[bytes] = []
    firsts: list[int] = []
    counts: list[int] = []
    for batch in batches:
        paths += batch.column("path").to_pylist()
        sizes += batch.column("sizes").to_pylist()
        firsts += batch.column("first_conv").to_pylist()
        counts += batch.column("n_convs").to_pylist()
    if not paths:
        yield _batch([])
        return
    pairs = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2)
    _, encoded = np.unique(pairs, axis=0, return_inverse=True)
    encoded = encoded.reshape(-1)
    starts = np.concatenate(([0], np.cumsum([len(p) // DIGEST for p in paths])))
    tree = _TernaryTree()
    for i in _medians(len(paths)):
        tree.insert(encoded[starts[i] : starts[i + 1]], i)
    ends = {p: i for i, p in enumerate(paths)}
    border = set(_node_ids(paths[0])) | set(_node_ids(paths[-1]))
    out: list[tuple] = []
    # Each entry: node, depth, id, parent's id, size, children left, and what is known so far:
    # first member, members, children, leaves, saved; settled children to be named their parent.
    root = hashlib.md5()

    def enter(node: int, depth: int, digest, parent: bytes | None) -> dict:
        i = tree.path[node]
        path = paths[i]
        end = ends.get(path[: depth * DIGEST])
        return {
            "node": node, "depth": depth, "digest": digest, "id": digest.digest(), "parent": parent,
            "size": int.from_bytes(sizes[i][4 * depth - 4 : 4 * depth], "little") if depth else 0,
            "todo": tree.children(node)[::-1], "first": firsts[end] if end is not None else None,
            "n": counts[end] if end is not None else 0, "children": 0, "leaves": 0, "saved": 0, "below": [], "open": False,
        }

    stack = [enter(0, 0, root, None)]
    while stack:
        top = stack[-1]
        if top["todo"]:
            child = top["todo"].pop()
            digest = top["digest"].copy()
            at = DIGEST * top["depth"]
            digest.update(paths[tree.path[child]][at : at + DIGEST])
            stack.append(enter(child, top["depth"] + 1, digest, top["id"]))
            continue
        stack.pop()
        shared = top["id"] in border
        if not shared:
            top["leaves"] += not top["children"]
            top["saved"] += (top["n"] - 1) * top["size"]
        row = (top["id"], top["parent"], top["depth"], top["size"], top["first"])
        rest = (top["n"], top["children"], top["leaves"], top["saved"], shared, shard)
        if stack:
            above = stack[-1]
            above["n"] += top["n"]
            above["first"] = top["first"] if above["first"] is None else min(above["first"], top["first"])
            if not shared:
                above["children"] += 1
                above["leaves"] += top["leaves"]
                above["saved"] += top["saved"]
        # A node is written once its parent's smallest member is known; of a border parent it never is here.
        out += [(*r, top["first"], *x) for r, x in top["below"]]
        if not stack or stack[-1]["id"] in border:
            out.append((*row, None, *rest))
        else:
            stack[-1]["below"].append((row, rest))
        while len(out) >= BATCH:
            yield _batch(out[:BATCH])
            out = out[BATCH:]
    yield _batch(out)


def _merge(last_round: bool):
    """Boundary nodes of neighbour shards -> the same nodes merged; those at the group's ends stay open."""

    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.astype({"id": object})
        ends = nodes.groupby("shard")
        order = sorted(ends.groups)
        first, last = nodes.loc[ends.groups[order[0]]], nodes.loc[ends.groups[order[-1]]]
        merged = nodes.groupby("id", sort=False).agg(
            parent=("parent", "first"), depth=("depth", "first"), size=("size", "first"), first_conv=("first_conv", "min"),
            n_convs=("n_convs", "sum"), n_children=("n_children", "sum"), n_leaves=("n_leaves", "sum"), saved=("saved", "sum"),
        )
        # Not known which of a shard's two border paths a node is on: both stay open, which is safe.
        still = set() if last_round else set(first["id"]) | set(last["id"])
        table = merged.to_dict("index")
        for node in sorted(table, key=lambda k: -table[k]["depth"]):
            x = table[node]
            x["border"] = node in still
            if x["border"]:
                continue
            x["n_leaves"] += x["n_children"] == 0
            x["saved"] += (x["n_convs"] - 1) * x["size"]
            if x["depth"]:
                above = table[x["parent"]]
                above["n_children"] += 1
                above["n_leaves"] += x["n_leaves"]
                above["saved"] += x["saved"]
        group = int(nodes["shard"].iloc[0]) // FAN
        rows = [
            (k, x["parent"], x["depth"], x["size"], x["first_conv"], None, x["n_convs"], x["n_children"], x["n_leaves"], x["saved"], x["border"], group)
            for k, x in table.items()
        ]
        return pd.DataFrame(rows, columns=NAMES).astype({"parent_conv": "Int64"})

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(end, conv_id) in order -> end, hash of its conversations' ids."""
    now, digest = None, None
    done: list[tuple[bytes, str]] = []

    def close() -> pa.RecordBatch:
        ids, hashes = zip(*done) if done else ((), ())
        return pa.RecordBatch.from_pydict({"end": pa.array(ids, pa.binary()), "ends_sha256": pa.array(hashes, pa.string())})

    for batch in batches:
        for end, conv_id in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if end != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                    if len(done) >= BATCH:
                        yield close()
                        done = []
                now, digest = end, hashlib.sha256(str(conv_id).encode())
            else:
                digest.update(f",{conv_id}".encode())
    if now is not None:
        done.append((now, digest.hexdigest()))
    yield close()


def trie_nodes(turns: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    paths = kept(rebuilt_paths(turns), "trie-paths")
    end = F.unhex(F.md5("path"))
    ends = (
        paths.select(end.alias("end"), "conv_id").repartition("end").sortWithinPartitions("end", "conv_id")
        .mapInArrow(_ends, "end binary, ends_sha256 string")
    )
    distinct = paths.groupBy("path").agg(F.first("sizes").alias("sizes"), F.min("conv_id").alias("first_conv"), F.count("*").alias("n_convs"))
    volume = paths.agg(F.sum(F.octet_length("path")).alias("bytes")).first()["bytes"] or 0
    shards = max(int(volume // SHARD_BYTES) + 1, min(spark.sparkContext.defaultParallelism, int(volume // 100_000) + 1))
    nodes = kept(
        distinct.repartitionByRange(shards, "path").sortWithinPartitions("path").mapInArrow(_shard, NODE), "trie-nodes"
    )
    settled, border, groups = [nodes.filter("not border")], nodes.filter("border"), shards
    while True:
        last_round = groups <= FAN
        merged = kept(
            border.groupBy((F.col("shard") / FAN).cast("long").alias("group"))
            .applyInPandas(_merge(last_round), NODE), "trie-border",
        )
        settled.append(merged.filter("not border"))
        if last_round:
            break
        border, groups = merged.filter("border"), -(-groups // FAN)
    once = settled[1]
    for more in settled[2:]:
        once = once.unionByName(more)
    every = settled[0].unionByName(once)
    names = once.select(F.col("id").alias("above"), F.col("first_conv").alias("above_conv"))
    if names.count() <= BROADCAST_NODES:
        names = F.broadcast(names)
    return (
        every.join(names, every["parent"] == names["above"], "left")
        .join(ends, F.col("id") == ends["end"], "left")
        .select(
            F.col("first_conv").alias("conv_id"), "depth", F.coalesce("parent_conv", "above_conv").alias("parent_conv_id"),
            "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        )
    )


#: Checksum of a string of ASCII characters; ``{0}`` is the string.
CRC32 = """xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(({0})[i])::BIGINT),
  lambda acc, b: xor(acc >> 8, list_reduce(range(8)::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
    xor(acc, b) & 255)), 4294967295), 4294967295)"""

SQL = f"""
WITH turns AS (
  SELECT conv_id, md5(concat(strlen(r), ':', r, ':', t)) AS digest, strlen(t) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(strlen(r), ':', r, ':', t))) AS k
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS lender, {CRC32.format("conv_id::VARCHAR")} % {MOST_SHARED + 1} AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, t.k, t.digest, t.size FROM convs c JOIN turns t ON t.conv_id = c.lender AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, t.k, t.digest, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, size,
    count(*) OVER (PARTITION BY conv_id) AS turns
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)
), members AS (
  SELECT conv_id, depth, path, size, depth = turns AS ends FROM paths
  UNION ALL
  SELECT conv_id, 0, '', 0, NOT EXISTS (SELECT 1 FROM rebuilt r WHERE r.conv_id = convs.conv_id) FROM convs
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY path, depth
), children AS (
  SELECT left(path, 32 * (depth - 1)) AS parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), sums AS (
  SELECT a.path, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved
  FROM nodes a JOIN nodes b ON starts_with(b.path, a.path) LEFT JOIN children c ON c.parent = b.path GROUP BY a.path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves,
  s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (path) LEFT JOIN children c ON c.parent = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth - 1))
"""
