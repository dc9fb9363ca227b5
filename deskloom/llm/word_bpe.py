"""Byte-level BPE encoding and decoding; distinct words are merged by Spark's higher-order functions.

A text is cut into words by the vocabulary's pattern. The ranks are a literal map, dealt into small
maps by a checksum of the key so that a lookup compares a few keys only. A word is an array of its
bytes (in hex); ``aggregate`` folds over it and each step joins the leftmost of the best-ranked
neighbours until none is left (``WordCodec.fold``). The distinct space-separated stretches of all
texts are counted, the frequent ones are folded once each, and their ids go to all tasks as a table
of bounded size. Documents are then put together in Arrow batches from that table. What is not in
it is merged on the spot by the same ranks, with a heap where it is long, and remembered by the
worker within bounds; so the size of the table changes the speed and no result. Folding such words
inside the rows gives the same ids at a higher cost (figures in the README).

Decoding concatenates the binary piece of each id.

Characters: the JVM's tables end at an older Unicode version than the library's, so only stretches
whose code points the JVM knows are folded; the rest asks the library for each character's class.

Null text: empty. Texts may be empty or of any length; a row needs memory for its own text and ids.
Ids may be null or repeat; each row is encoded on its own. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from deskloom.llm.chunks import ChunkEncoder
from deskloom.llm.common import pick, text_slices

#: Distinct stretches between spaces whose ids are folded once and sent to all tasks, and the
#: longest of them in characters: a table of some 10 MB.
KNOWN_WORDS, KNOWN_CHARS = 60_000, 40
#: Keys of a literal map that share one small map, on average.
PER_BUCKET = 2
#: Bytes of a word from which a heap pays.
LONG = 48
#: Characters of stretches that a worker remembers, with eight for each: some 100 MB.
REMEMBERED = 8_000_000
#: Words of a worker's table for texts that cannot be cut at spaces.
WORDS_KEPT = 100_000


@lru_cache(maxsize=4)
def load_ranks(ranks_file: str) -> dict[bytes, int]:
    """Rank of each piece, from lines of a base64 piece and its rank."""
    with open(ranks_file, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _bucket(key: str, buckets: int) -> int:
    return zlib.crc32(key.encode()) % buckets


class _LiteralMap:
    """A constant map as an array of small maps. ``bound`` names it once for an expression, as the
    literal is large; the map that it hands over gives null for a missing key."""

    def __init__(self, entries: dict, value_type: str):
        self.buckets = max(1, len(entries) // PER_BUCKET)
        dealt: list[dict] = [{} for _ in range(self.buckets)]
        for key, value in entries.items():
            dealt[_bucket(key, self.buckets)][key] = value
        # from_json of a literal is folded to a literal once, when the plan is optimised.
        self.literal = F.from_json(F.lit(json.dumps(dealt, ensure_ascii=False)), f"array<map<string,{value_type}>>")

    def bound(self, use) -> Column:
        return _let(self.literal, lambda literal: use(_Bound(literal, self.buckets)))


class _Bound:
    def __init__(self, literal: Column, buckets: int):
        self.literal, self.buckets = literal, buckets

    def __getitem__(self, key: Column) -> Column:
        at = (F.crc32(key) % F.lit(self.buckets) + 1).cast("int")
        return F.try_element_at(F.element_at(self.literal, at), key)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


class WordCodec:
    """Column expressions over one vocabulary."""

    def __init__(self, ranks_file: str):
        import public_tokenizers

        self.ranks_file, self.pattern = ranks_file, public_tokenizers.PATTERN
        ranks = load_ranks(ranks_file)
        self.ranks = _LiteralMap({piece.hex().upper(): rank for piece, rank in ranks.items()}, "int")

    def words(self, text: Column) -> Column:
        """The pattern's matches; white space as in Unicode."""
        return F.regexp_extract_all(text, F.lit(f"(?U){self.pattern}"), F.lit(0))

    def fold(self, word: Column, ranks: _Bound) -> Column:
        """Ids of one word: the word itself if it is a piece, else the ranked merges over its bytes."""

        def pieces_of(hexed: Column) -> Column:
            starts = F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2))
            return F.transform(starts, lambda i: F.substr(hexed, i, F.lit(2)))

        def start(pieces: Column) -> Column:
            pairs = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces) - 1), lambda a, b: ranks[F.concat(a, b)])
            return F.struct(pieces.alias("p"), pairs.alias("r"))

        def merged(acc: Column, at: Column) -> Column:
            p, r = acc["p"], acc["r"]
            joined = F.concat(F.get(p, at - 1), F.get(p, at))
            before, after = F.get(p, at - 2), F.get(p, at + 1)
            # Positions outside the array give null, and a null pair has no rank.
            left = F.when(at > 1, F.array(ranks[F.concat(before, joined)])).otherwise(F.array().cast("array<int>"))
            right = F.when(at < F.size(r), F.array(ranks[F.concat(joined, after)])).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), at - 1), F.array(joined), F.slice(p, at + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r))).alias("r"),
            )

        def step(acc: Column, _: Column) -> Column:
            best = F.array_min(acc["r"])
            return F.when(best.isNull(), acc).otherwise(
                _let(F.array_position(acc["r"], best).cast("int"), lambda at: merged(acc, at))
            )

        def run(hexed: Column) -> Column:
            folded = F.aggregate(
                F.sequence(F.lit(1), F.greatest(F.length(hexed) - 2, F.lit(1)), F.lit(2)),
                _let(pieces_of(hexed), start), step, lambda acc: acc["p"],
            )
            whole = ranks[hexed]
            return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, lambda p: ranks[p]))

        return _let(F.hex(word), run)


def frequent_words(texts: DataFrame, codec: WordCodec, limit: int = KNOWN_WORDS) -> DataFrame:
    """word, ids of the most frequent stretches of ``text`` between single spaces, each with a space before it.

    Stretches that begin or end with white space share it with their neighbours and stay out.
    """
    words = texts.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").count()
    alone = F.col("word").rlike(rf"(?U)^(?=\S.{{0,{KNOWN_CHARS - 1}}}$)[^\p{{Cn}}]*\S$")
    top = words.filter(alone).orderBy(F.desc("count"), "word").limit(limit)
    spaced = F.concat(F.lit(" "), F.col("word"))
    ids = codec.ranks.bound(lambda ranks: F.flatten(F.transform(codec.words(spaced), lambda w: codec.fold(w, ranks))))
    # The limit leaves one partition; the fold is the work.
    return top.select("word").repartition(texts.sparkSession.sparkContext.defaultParallelism).select("word", ids.alias("ids"))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: best rank first, leftmost of equals."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG:
        return _merge_with_heap(word, ranks)
    pieces = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks) + 256
    pairs = [ranks.get(a + b, none) for a, b in zip(pieces, pieces[1:])]
    while pairs and (best := min(pairs)) < none:
        at = pairs.index(best)
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(pieces[at - 1] + pieces[at], none)
        if at < len(pairs):
            pairs[at] = ranks.get(pieces[at] + pieces[at + 1], none)
    return [ranks[p] for p in pieces]


def _merge_with_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps."""
    n = len(word)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    gone = bytearray(n)
    agenda: list[tuple[int, int, int]] = []

    def offer(left: int, right: int) -> None:
        if left >= 0 and right < n and (rank := ranks.get(word[left : ends[right]])) is not None:
            heapq.heappush(agenda, (rank, left, ends[right]))

    for i in range(n - 1):
        offer(i, i + 1)
    while agenda:
        _, left, end = heapq.heappop(agenda)
        right = after[left]
        # The pair still stands if the left piece does and its neighbour ends where it did.
        if gone[left] or right >= n or ends[right] != end:
            continue
        gone[right], ends[left], after[left] = 1, end, after[right]
        if after[left] < n:
            before[after[left]] = left
        offer(before[left], left)
        offer(left, after[left])
    return [ranks[word[i : ends[i]]] for i in range(n) if not gone[i]]


class _Classes:
    """The library's letters, numbers and white space, asked of the library itself for each new character."""

    def __init__(self):
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)}
        self.tests = [
            (sign, tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
            for kind, sign in ((r"\p{L}", "é"), (r"\p{N}", "²"), (r"\s", "\u00a0"))
        ]
        self.signs: dict[int, str] = {}

    def __getitem__(self, code: int) -> str | int:
        if code < 128:
            return code
        if code not in self.signs:
            self.signs[code] = next((sign for sign, found in self.tests if found(chr(code))), "¡")
        return self.signs[code]


class _Chunks(ChunkEncoder):
    """Known chunks beside a table that stays when the rest is forgotten."""

    def __init__(self, encode_new, encode_whole, folded: dict[str, bytes]):
        super().__init__(encode_new, encode_whole, limit=REMEMBERED)
        self.folded, self.later = folded, dict(folded)

    def _thin(self) -> None:
        self.first, self.later, self.held = {}, dict(self.folded), 0


class WordEncoder:
    """Texts to little-endian 32-bit ids in a Python worker."""

    def __init__(self, ranks_file: str, folded: dict[str, bytes]):
        import public_tokenizers
        import regex

        self.ranks, self.classes = load_ranks(ranks_file), _Classes()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.little_endian = [i.to_bytes(4, "little") for i in range(max(self.ranks.values()) + 1)]
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.chunks = _Chunks(self._new, self._whole, folded)

    def _cut(self, text: str) -> Iterator[str]:
        if text.isascii():
            return iter(self.pattern.findall(text))
        # Each character stands for its class, so that any table of characters cuts alike.
        return (text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.classes)))

    def _word(self, word: str) -> bytes:
        return b"".join([self.little_endian[i] for i in merge(word.encode(), self.ranks)])

    def _tail(self, word: str) -> bytes:
        """Words that follow the first of a chunk are mostly the same few marks and letters."""
        ids = self.tails.get(word)
        if ids is None:
            if len(self.tails) >= WORDS_KEPT:
                self.tails.clear()
            ids = self.tails[word] = self._word(word)
        return ids

    def _whole(self, text: str) -> bytes:
        """A text whose chunks do not stand for themselves, word by word."""
        words, out = self.words, []
        for word in self._cut(text):
            ids = words.get(word)
            if ids is None:
                ids = self._word(word)
                if len(words) >= WORDS_KEPT:
                    words.clear()
                if len(word) <= KNOWN_CHARS:
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def _new(self, chunks: list[str], first: bool, known: dict) -> list[bytes | None]:
        out: list[bytes | None] = []
        for chunk in chunks:
            if (not chunk and not first) or chunk[:1].isspace() or chunk[-1:].isspace():
                out.append(None)  # white space at an end belongs together with what stands next to it
                continue
            spaced = chunk if first else f" {chunk}"
            if chunk.isascii() and chunk.isalpha():  # letters alone are one word
                out.append(self._word(spaced))
                continue
            head, *rest = self._cut(spaced) if spaced else ("",)
            ids = known.get(head[1:]) if head[:1] == " " and not first else None
            if ids is None:
                ids = self._word(head)
                if rest and not first and head[1:].isalpha():  # other marks may follow it elsewhere
                    known[head[1:]] = ids
                    self.chunks.held += len(head) + 8
            out.append(ids + b"".join(map(self._tail, rest)) if rest else ids)
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.chunks(texts)


def _run(ranks_file: str, folded, row):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pieces = WordEncoder(ranks_file, folded.value), _pieces(ranks_file)
        for batch in batches:
            for a, b in text_slices(batch, "text", 1 << 21):
                values = encode(["" if t is None else t for t in batch.column("text")[a:b].to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[a:b], **row(values, pieces)})

    return run


def _pieces(ranks_file: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = load_ranks(ranks_file)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def decode(value: bytes, pieces: list[bytes]) -> bytes:
    """The pieces of the ids, concatenated."""
    return b"".join(map(pieces.__getitem__, np.frombuffer(value, "<u4").tolist()))


def _id_rows(values: list[bytes], pieces: list[bytes]) -> dict:
    return {
        "ids": pa.array([np.frombuffer(v, "<i4") for v in values], pa.list_(pa.int32())),
        "decoded": pa.array([decode(v, pieces) for v in values], pa.binary()),
    }


def _digest_rows(values: list[bytes], pieces: list[bytes]) -> dict:
    return {
        "n_tokens": pa.array([len(v) // 4 for v in values], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(v).hexdigest() for v in values]),
        "decoded_sha256": pa.array([hashlib.sha256(decode(v, pieces)).hexdigest() for v in values]),
    }


def _encoded(docs: DataFrame, ranks_file: str, doc_id: str, text: str, known_words: int, row, schema: str) -> DataFrame:
    own = pick(docs, doc_id=doc_id, text=text)
    found = frequent_words(own, WordCodec(ranks_file), known_words).collect()
    folded = {r["word"]: np.array(r["ids"], "<u4").tobytes() for r in found}
    shared = docs.sparkSession.sparkContext.broadcast(folded)
    return own.mapInArrow(_run(ranks_file, shared, row), schema)


def encode_documents(
    docs: DataFrame, ranks_file: str, *, doc_id: str = "doc_id", text: str = "text", known_words: int = KNOWN_WORDS
) -> DataFrame:
    """doc_id, ids, decoded: every whole text by the ranks, without special tokens, and decoded again."""
    return _encoded(docs, ranks_file, doc_id, text, known_words, _id_rows, "doc_id long, ids array<int>, decoded binary")


def encoding_digests(
    docs: DataFrame, ranks_file: str, *, doc_id: str = "doc_id", text: str = "text", known_words: int = KNOWN_WORDS
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as 32-bit words), decoded_sha256 (of the bytes of the decoded ids)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, ranks_file, doc_id, text, known_words, _digest_rows, schema)
