"""Token ids as files of patched frame-of-reference blocks, written and read back by Spark.

Documents are dealt out by ranges of their id and sorted, so the files hold them in ascending
order. A shard is one self-describing byte string: header, document table (id, tokens), block
index (where each block starts), blocks. A block holds up to ``BLOCK`` ids of the shard: its
minimum, a bit width that ``PERCENTILE`` percent of the differences fit, the packed low bits, and
an exception list (position, whole difference) for the others. Spark's Parquet writer carries the
shards and commits them, so a lost executor or a repeated task leaves no half file.

Null text: empty. Null id: sorted first. Repeated ids: one document each, in the order of their
text. Empty table: no shard, no rows. Further columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from deskloom.llm.chunks import ChunkEncoder
from deskloom.llm.common import pick, shared_folder, text_slices

BLOCK = 512
PERCENTILE = 97
#: A shard is closed once it holds so many ids; it always holds whole documents.
SHARD_TOKENS = 1 << 19
MAGIC = b"PFOR1\0\0\0"
#: Marks that may follow a word; all are neither letter, digit, apostrophe nor white space.
MARKS = ".,;:!?*$%&#|)]}\""
#: Stands for a null id in the document table.
NO_ID = -(1 << 63)

SHARD_SCHEMA = "first_id long, part int, start_in_part long, n_docs long, n_tokens long, payload binary"
READ_SCHEMA = "doc_id long, part int, start long, n_tokens long, ids_crc32 long"


# --- blocks -----------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(k, BLOCK) numbers below 2**width to (k, BLOCK * width / 64) little-endian 64-bit words."""
    k = len(values)
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T).astype(np.uint64)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        words[word] |= lanes[lane] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(k, -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    k = len(words)
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, lanes.shape[1]), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        out[lane] = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            out[lane] |= lanes[word + 1] << np.uint64(64 - shift)
    out &= np.uint64((1 << width) - 1)
    return np.ascontiguousarray(out.T).astype(np.uint32).reshape(k, BLOCK)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Start of each block within the body, and the body."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), b""
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[n - 1]
    table = padded.reshape(blocks, BLOCK)
    low = table.min(axis=1)
    diff = table - low[:, None]
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    typical = np.partition(diff, at, axis=1)[:, at]
    width = np.frexp(typical.astype(np.float64))[1].astype(np.uint8)  # bits of the number, 0 for 0
    limit = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    odd = diff > limit[:, None]
    n_odd = odd.sum(axis=1)
    parts: list[bytes] = [b""] * blocks
    kept = np.where(odd, 0, diff)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        packed = _pack(kept[rows], int(w)) if w else np.zeros((len(rows), 0), np.uint64)
        for row, words in zip(rows.tolist(), packed, strict=True):
            parts[row] = words.tobytes()
    where_row, where_at = np.nonzero(odd)
    bounds = np.concatenate(([0], np.cumsum(n_odd)))
    at16, value32 = where_at.astype("<u2"), diff[where_row, where_at].astype("<u4")
    body, starts, size = [], np.empty(blocks, np.uint64), 0
    for row in range(blocks):
        a, b = bounds[row], bounds[row + 1]
        block = b"".join(
            (struct.pack("<IBH", low[row], width[row], b - a), parts[row], at16[a:b].tobytes(), value32[a:b].tobytes())
        )
        starts[row] = size
        size += len(block)
        body.append(block)
    return starts, b"".join(body)


def unpack_blocks(starts: np.ndarray, body: bytes, n: int) -> np.ndarray:
    """All ids of a shard, from the start of each block."""
    heads = [struct.unpack_from("<IBH", body, s) for s in starts.tolist()]
    out = np.empty((len(heads), BLOCK), np.uint32)
    by_width: dict[int, list[int]] = {}
    for row, (_, width, _) in enumerate(heads):
        by_width.setdefault(width, []).append(row)
    for width, rows in by_width.items():
        if not width:
            out[rows] = 0
            continue
        size = BLOCK * width // 8
        words = np.frombuffer(
            b"".join([body[(s := int(starts[row]) + 7) : s + size] for row in rows]), np.uint64
        ).reshape(len(rows), -1)
        out[rows] = _unpack(words, width)
    for row, (low, width, odd) in enumerate(heads):
        if odd:
            at = int(starts[row]) + 7 + BLOCK * width // 8
            out[row, np.frombuffer(body, "<u2", odd, at)] = np.frombuffer(body, "<u4", odd, at + 2 * odd)
        out[row] += np.uint32(low)
    return out.reshape(-1)[:n]


def write_shard(doc_ids: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    starts, body = pack_blocks(ids)
    return b"".join(
        (
            MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(starts)),
            np.asarray(doc_ids, "<i8").tobytes(), np.asarray(counts, "<u8").tobytes(),
            starts.astype("<u8").tobytes(), body,
        )
    )


def read_shard(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, tokens of each, all token ids."""
    if payload[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    docs, tokens, blocks = struct.unpack_from("<QQQ", payload, 8)
    at = 32
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    counts = np.frombuffer(payload, "<u8", docs, at + 8 * docs).astype(np.int64)
    starts = np.frombuffer(payload, "<u8", blocks, at + 16 * docs)
    ids = unpack_blocks(starts, payload[at + 16 * docs + 8 * blocks :], tokens)
    if counts.sum() != tokens or len(ids) != tokens:
        raise ValueError("a shard of token ids is damaged")
    return doc_ids, counts, ids


# --- encoding ---------------------------------------------------------------------

_encoders: dict[tuple[str, int], ChunkEncoder] = {}
#: Words that go to the merges in one call.
WORDS_AT_ONCE = 20_000


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def encoder(tokenizer_file: str, end_id: int) -> ChunkEncoder:
    """The tokenizer of this Python worker; values are little-endian unsigned 32-bit ids."""
    key = (tokenizer_file, end_id)
    if key not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

        def library(strings: list[str]) -> list[bytes]:
            found = [e.ids for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) * 4
            raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
            return [raw[a:b] for a, b in pairwise([0, *ends.tolist()])]

        # Single words need no further cutting: they are spelled in the letters that stand for bytes
        # and go to the merges together, parted by the letter of the line break, which no word has.
        letters = byte_letters()
        words = Tokenizer.from_file(tokenizer_file)
        words.pre_tokenizer = Split(letters[10], "isolated")
        line_break = words.token_to_id(letters[10])

        def encode_words(strings: list[str]) -> list[bytes]:
            if line_break is None or tokenizer.normalizer is not None:
                return library(strings)
            out: list[bytes] = []
            for low in range(0, len(strings), WORDS_AT_ONCE):
                spelled = "\n".join(strings[low : low + WORDS_AT_ONCE]).encode().decode("latin-1").translate(letters)
                ids = np.array(words.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
                raw, start = ids.tobytes(), 0
                for end in (4 * np.append(np.flatnonzero(ids == line_break), len(ids))).tolist():
                    out.append(raw[start:end])
                    start = end + 4
            return out

        tails: dict[str, bytes] = {}

        def encode_new(chunks: list[str], first: bool, known: dict) -> None:
            # The pre-tokenizer always cuts between letters and the marks after them.
            bare = dict.fromkeys(filter(str.isalpha, chunks))
            split, whole = [], []
            for chunk in filterfalse(str.isalpha, chunks):
                core = chunk.rstrip(MARKS)
                if core.isalpha():
                    split.append((chunk, core))
                    if core not in known:
                        bare[core] = None
                else:
                    whole.append(chunk)
            known.update(zip(bare, encode_words(list(bare) if first else [f" {c}" for c in bare]), strict=True))
            value = dict(zip(whole, library(whole if first else [f" {c}" for c in whole]), strict=True))
            for chunk in value:
                # A chunk that borders on white space shares it with its neighbour.
                if (not chunk and not first) or chunk[:1].isspace() or chunk[-1:].isspace():
                    value[chunk] = None
            known.update(value)
            for chunk, core in split:
                tail = chunk[len(core) :]
                if (marks := tails.get(tail)) is None:
                    if len(tails) > 10_000:
                        tails.clear()
                    marks = tails[tail] = library([tail])[0]
                known[chunk] = known[core] + marks

        def encode_whole(text: str) -> bytes:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        _encoders[key] = ChunkEncoder(encode_new, encode_whole)
    return _encoders[key]


def _shards(tokenizer_file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer_file, end_id), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        doc_ids: list[int] = []
        values: list[bytes] = []
        held = done = 0

        def close() -> pa.RecordBatch:
            counts = [len(v) // 4 for v in values]
            payload = write_shard(doc_ids, counts, np.frombuffer(b"".join(values), "<u4"))
            return pa.RecordBatch.from_pydict(
                {
                    "first_id": pa.array([None if doc_ids[0] == NO_ID else doc_ids[0]], pa.int64()),
                    "part": pa.array([part], pa.int32()), "start_in_part": pa.array([done], pa.int64()),
                    "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([held], pa.int64()),
                    "payload": pa.array([payload], pa.binary()),
                }
            )

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for a, b in text_slices(batch, "text", 1 << 21):
                encoded = encode(["" if t is None else t for t in texts[a:b].to_pylist()])
                for doc_id, value in zip(ids[a:b].to_pylist(), encoded, strict=True):
                    doc_ids.append(NO_ID if doc_id is None else doc_id)
                    values.append(value + end)
                    held += len(value) // 4 + 1
                    if held >= SHARD_TOKENS:
                        yield close()
                        done, held, doc_ids, values = done + held, 0, [], []
        if doc_ids:
            yield close()

    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer_file: str, *, end_id: int = 0,
                    doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts and write the shards of all documents under ``path``."""
    own = pick(docs, doc_id=doc_id, text=text)
    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_shards(tokenizer_file, end_id), SHARD_SCHEMA).write.option(
        "compression", "none"
    ).parquet(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            doc_ids, counts, ids = read_shard(batch.column("payload")[row].as_py())
            raw, bounds = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(counts)))
            start = batch.column("start_in_part")[row].as_py()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID),
                    "part": pa.array(np.full(len(doc_ids), batch.column("part")[row].as_py(), np.int32)),
                    "start": pa.array(start + bounds[:-1], pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array(
                        [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())],
                        pa.int64(),
                    ),
                }
            )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document: id, ids of all documents before it, its ids, their checksum; all from the files."""
    shards = spark.read.parquet(path)
    # One row for each written partition, which is what the window below orders.
    parts = shards.groupBy("part").agg(F.min("first_id").alias("low"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy(F.col("low").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = shards.select("part", "start_in_part", "payload").mapInArrow(_digest, READ_SCHEMA)
    return rows.join(base, "part").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_id_files(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write all documents' ids into the shared folder and read them back."""
    spark = docs.sparkSession
    path = shared_folder(spark, "token-ids")
    write_token_ids(docs, path, tokenizer_file)
    return read_token_ids(spark, path)
