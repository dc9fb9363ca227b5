"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs in the order of their scores: the pair whose
joined piece scores highest is merged first, the leftmost of equals, until no pair is a piece. The
agendas of many chunks advance in step, one merge for each chunk and round, as numpy arrays; a
very long chunk has a heap of its own. Symbols outside the vocabulary become byte pieces.

A chunk ends before each run of the space mark. No piece has a space mark after another character
(checked when a model is loaded), so no merge crosses that border. Every newly encoded chunk is
checked against the sentencepiece library within its Arrow batch; a difference stops the job.

Null text: empty. Texts may be empty or of any length. Ids may be null or repeat; each row is
encoded on its own. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from deskloom.llm.chunks import KNOWN_CHARS, ChunkEncoder, give_back
from deskloom.llm.common import pick, text_slices

SPACE = "▁"
#: Symbols of a chunk above which it gets its own heap.
LONG = 40
#: Chunks whose agendas advance in step.
TOGETHER = 1 << 15

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """Vocabulary of a merge-type model and its agenda."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        normal = [
            i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))
        ]
        if any(SPACE in p[1:] and p.strip(SPACE) for p in (pieces[i] for i in normal)):
            raise ValueError("a piece goes on after a space mark: chunks would not stand alone")
        self.ids = {pieces[i]: i for i in normal}
        self.decimal = [str(i) for i in range(size)]
        self.of_char = -2 - np.arange(0x110000, dtype=np.int32)
        for i in normal:
            if len(pieces[i]) == 1:
                self.of_char[ord(pieces[i])] = i
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        self.fallback = self.bytes[0] != self.unknown
        scores = np.array([lib.get_score(i) for i in range(size)], np.float64)
        # Rank 0 is the best score; equal scores share a rank, so that the leftmost pair wins.
        order = np.unique(-scores[normal])
        self.rank = np.full(size, len(order), np.int64)
        self.rank[normal] = np.searchsorted(order, -scores[normal])
        self.no_pair = len(order)
        merges: dict[int, int] = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    merges[left * size + right] = i
        self.merges, self.size = merges, size
        self._table()

    def _table(self) -> None:
        """Open addressing over the pairs, for lookups of whole arrays."""
        bits = max(10, int(len(self.merges) * 4).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        for key, value in self.merges.items():
            at = int((key * 0x9E3779B97F4A7C15 % (1 << 64)) >> int(self.shift))
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, value

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece of each pair, -1 for none."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        out = np.full(key.shape, -1, np.int64)
        open_ = np.flatnonzero(key != -2)
        at, key = at[open_], key[open_]
        while len(open_):
            found = self.keys[at]
            hit = found == key
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (found != -1)
            open_, key, at = open_[go], key[go], (at[go] + 1) & self.mask
        return out

    def _symbols(self, chunk: str) -> list[int]:
        """Ids of the characters; -2 - code point for a character outside the vocabulary."""
        return self.of_char[np.frombuffer(chunk.encode("utf-32-le"), "<u4")].tolist()

    def _bytes_of(self, symbol: int) -> list[int]:
        if not self.fallback:
            return [self.unknown]
        return [self.bytes[b] for b in chr(-2 - symbol).encode()]

    def _value(self, symbols: list[int]) -> bytes:
        ids = [i for s in symbols for i in ((s,) if s >= 0 else self._bytes_of(s))]
        if not self.fallback:  # the library joins neighbours outside the vocabulary
            ids = [i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != self.unknown]
        return np.array(ids, "<u4").tobytes()

    def _in_step(self, chunks: list[str]) -> list[bytes]:
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        width = int(lengths.max(initial=1)) + 1
        columns = np.arange(width)
        table = np.full((len(chunks), width), -1, np.int32)
        table[columns < lengths[:, None]] = self.of_char[
            np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        ]
        joined = np.full((len(chunks), width), -1, np.int32)
        joined[:, :-1] = self._joined(table[:, :-1].ravel(), table[:, 1:].ravel()).reshape(len(chunks), -1)
        rank_of = np.append(self.rank, self.no_pair).astype(np.int32)  # -1 finds the last entry
        ranks = rank_of[joined]
        # Rows without a pair leave the agenda; ``rows`` tells which chunks are still in it.
        rows, done = np.arange(len(chunks)), []
        while True:
            at = ranks.argmin(axis=1)
            good = ranks[np.arange(len(rows)), at] < self.no_pair
            if not good.all():
                done.append((rows[~good], table[~good]))
                rows, table, joined, ranks, at = rows[good], table[good], joined[good], ranks[good], at[good]
            if not len(rows):
                break
            # Take out the right half of each merged pair and move what follows it.
            every = np.arange(len(rows))
            piece = joined[every, at]
            keep = columns != at[:, None] + 1
            for array, empty in ((table, -1), (joined, -1), (ranks, self.no_pair)):
                rest = array[keep].reshape(len(rows), width - 1)
                array[:, :-1] = rest
                array[:, -1] = empty
            lengths[rows] -= 1
            table[every, at] = piece
            right = self._joined(piece, table[every, at + 1])
            joined[every, at] = right
            ranks[every, at] = rank_of[right]
            inner = np.flatnonzero(at)
            before = at[inner] - 1
            left = self._joined(table[inner, before], piece[inner])
            joined[inner, before] = left
            ranks[inner, before] = rank_of[left]
        final = np.full((len(chunks), width), -1, np.int32)
        for which, symbols in done:
            final[which] = symbols
        flat = final[columns < lengths[:, None]]
        ends = np.cumsum(lengths)
        raw, bounds = flat.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        values = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        for row in np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), side="right")).tolist():
            values[row] = self._value(flat[bounds[row] // 4 : bounds[row + 1] // 4].tolist())
        return values

    def _by_heap(self, chunk: str) -> bytes:
        symbols = self._symbols(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n and symbols[left] >= 0 and symbols[right] >= 0:
                piece = self.merges.get(symbols[left] * self.size + symbols[right])
                if piece is not None:
                    heapq.heappush(agenda, (int(self.rank[piece]), left, right, piece, symbols[left] * self.size + symbols[right]))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = bytearray(n)
        while agenda:
            _, left, right, piece, key = heapq.heappop(agenda)
            if gone[left] or gone[right] or after[left] != right or symbols[left] * self.size + symbols[right] != key:
                continue
            symbols[left], gone[right] = piece, 1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return self._value([s for s, g in zip(symbols, gone, strict=True) if not g])

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of normalised chunks (space marks in place), by the agenda alone, as 32-bit words."""
        out: list[bytes] = [b""] * len(chunks)
        short = sorted((i for i, c in enumerate(chunks) if len(c) <= LONG), key=lambda i: len(chunks[i]))
        for a in range(0, len(short), TOGETHER):
            rows = short[a : a + TOGETHER]
            for i, ids in zip(rows, self._in_step([chunks[i] for i in rows]), strict=True):
                out[i] = ids
        for i, chunk in enumerate(chunks):
            if len(chunk) > LONG:
                out[i] = self._by_heap(chunk)
        return out

    def checked(self, chunks: list[str]) -> list[bytes]:
        """As encode_chunks, each compared with the library; chunks start with one space mark."""
        own = self.encode_chunks(chunks)
        # The library puts the first space mark in front by itself, and gives nothing for no text.
        theirs = self.library.encode([c[1:] for c in chunks], num_threads=1)
        lengths = np.fromiter(map(len, theirs), np.int64, len(theirs))
        same = np.fromiter(chain.from_iterable(theirs), "<u4", int(lengths.sum())).tobytes() == b"".join(
            own if SPACE not in chunks else [o for o, c in zip(own, chunks, strict=True) if c != SPACE]
        )
        if not same or any(4 * n != len(o) and c != SPACE for n, o, c in zip(lengths.tolist(), own, chunks, strict=True)):
            wrong = next(c for c, o, t in zip(chunks, own, theirs) if o != np.array(t, "<u4").tobytes() and c != SPACE)
            raise ValueError(f"the agenda and the library differ on {wrong[:80]!r}")
        return own

    def encode_text(self, text: str) -> bytes:
        """A whole text by its runs of space marks and what follows them."""
        if not text:
            return b""
        normal = SPACE + text.replace(" ", SPACE)
        return b"".join(self.checked(re.findall(f"{SPACE}+[^{SPACE}]*", normal)))


_models: dict[str, tuple[PieceModel, ChunkEncoder]] = {}


def model(model_file: str) -> tuple[PieceModel, ChunkEncoder]:
    """The model of this Python worker, and its encoder from texts to 32-bit little-endian ids."""
    if model_file not in _models:
        own = PieceModel(model_file)

        def encode_new(chunks: list[str], first: bool, known: dict) -> list[bytes | None]:
            # An empty chunk is a further space, a space mark one that is written out.
            alone = [c for c in chunks if c and SPACE not in c]
            value = dict(zip(alone, own.checked([SPACE + c for c in alone]), strict=True))
            return [value.get(c) for c in chunks]

        _models[model_file] = own, ChunkEncoder(encode_new, own.encode_text)
    return _models[model_file]


def encode(texts: list[str], model_file: str) -> list[list[int]]:
    """Ids of each text, the end id last."""
    own, encoder = model(model_file)
    return [np.frombuffer(ids, "<u4").tolist() + [own.end] for ids in encoder(texts)]


def _digest(model_file: str, known_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own, encoder = model(model_file)
        encoder.limit = known_chars
        for batch in batches:
            for a, b in text_slices(batch, "text", 1 << 21):
                texts = ["" if t is None else t for t in batch.column("text")[a:b].to_pylist()]
                numbers = encode(texts, model_file)
                decimal = own.decimal
                ids = [" ".join([decimal[i] for i in n]).encode() for n in numbers]
                decoded = [own.library.decode(n) for n in numbers]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id")[a:b],
                        "n_tokens": pa.array(map(len, numbers), pa.int64()),
                        "ids_sha256": pa.array(hashlib.sha256(i).hexdigest() for i in ids),
                        "decoded_sha256": pa.array(hashlib.sha256(d.encode()).hexdigest() for d in decoded),
                    }
                )

    return run


def _columns(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = model(model_file)
        for batch in batches:
            for a, b in text_slices(batch, "text", 1 << 21):
                texts = ["" if t is None else t for t in batch.column("text")[a:b].to_pylist()]
                numbers = encode(texts, model_file)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id")[a:b],
                        "ids": pa.array(numbers, pa.list_(pa.int32())),
                        "decoded": pa.array([own.library.decode(n) for n in numbers], pa.string()),
                    }
                )

    return run


def encode_documents(docs: DataFrame, model_file: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, decoded: every whole text in pieces with an end id, and decoded again."""
    own = pick(docs, doc_id=doc_id, text=text)
    return own.mapInArrow(_columns(model_file), "doc_id long, ids array<int>, decoded string")


def encoding_digests(
    docs: DataFrame, model_file: str, *, doc_id: str = "doc_id", text: str = "text", known_chars: int = KNOWN_CHARS
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, without sending ids or texts back to Spark.

    A worker keeps about ``known_chars`` characters of known chunks; fewer cost time and no result.
    """
    return pick(docs, doc_id=doc_id, text=text).mapInArrow(_digest(model_file, known_chars), SCHEMA)
