"""Encode texts by space-separated chunks whose encodings are kept from one Arrow batch to the next.

A tokenizer that never joins characters across a single space between two other characters gives
the ids of a text as the ids of its chunks, one after the other. Most chunks repeat, so the
expensive step runs once for each distinct chunk. Memory is bounded: the table of known chunks is
thinned to its short chunks, which are the frequent ones, when it holds ``limit`` characters.
"""

from __future__ import annotations

import ctypes
import gc
import weakref
from collections.abc import Callable, Iterable
from itertools import chain, filterfalse

import pyarrow as pa

#: Characters of known chunks in one Python worker, with eight for each chunk.
KNOWN_CHARS = 14_000_000
#: Chunks up to this length stay when the table is full.
SHORT = 7


_encoders: weakref.WeakSet[ChunkEncoder] = weakref.WeakSet()


def give_back() -> None:
    """Return what earlier tasks of this Python worker freed: the C library keeps it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def forget() -> None:
    """Empty the tables of this Python worker's encoders: tasks of another stage need the memory."""
    for encoder in _encoders:
        encoder.first, encoder.later, encoder.held = {}, {}, 0
    give_back()


class ChunkEncoder:
    """``encode_new(chunks, first, known)`` gives one value for each chunk, or None where the chunk
    does not stand for itself; a text with such a chunk goes to ``encode_whole``. ``first`` tells
    that the chunks start their text, so that no space comes before them; ``known`` has the values
    of such chunks so far and may be added to. One that has put all values there gives None at all."""

    def __init__(
        self,
        encode_new: Callable[[list[str], bool, dict], list[bytes | None] | None],
        encode_whole: Callable[[str], bytes],
        glue: bytes = b"",
        limit: int = KNOWN_CHARS,
    ):
        self.encode_new, self.encode_whole = encode_new, encode_whole
        self.glue, self.limit = glue, limit
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}
        self.held = 0
        _encoders.add(self)

    def _learn(self, known: dict, chunks: Iterable[str], first: bool) -> None:
        new = list(set(filterfalse(known.__contains__, chunks)))
        if new:
            values = self.encode_new(new, first, known)
            if values is not None:
                known.update(zip(new, values, strict=True))
            self.held += sum(map(len, new)) + 8 * len(new)

    def _thin(self) -> None:
        for name in ("first", "later"):
            kept = {k: v for k, v in getattr(self, name).items() if len(k) <= SHORT}
            setattr(self, name, kept)
        self.held = sum(len(k) + 8 for known in (self.first, self.later) for k in known)
        if self.held > self.limit // 2:
            self.first, self.later, self.held = {}, {}, 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The value of each text; texts of some MB at a time, as the caller slices them."""
        # Millions of strings in lists, none in a cycle: the collector would go through them again and again.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._values(texts)
        finally:
            if collects:
                gc.enable()

    def _values(self, texts: list[str]) -> list[bytes]:
        if self.held > self.limit:
            self._thin()
        split = [t.split(" ") for t in texts]
        starts = [parts.pop(0) for parts in split]
        self._learn(self.first, starts, True)
        self._learn(self.later, chain.from_iterable(split), False)
        out = []
        first, later, join = self.first, self.later, self.glue.join
        for text, start, parts in zip(texts, starts, split, strict=True):
            try:
                head = first[start]
                if parts:
                    tail = join(map(later.__getitem__, parts))
                    value = join((head, tail)) if head else b"".join((head, tail))
                else:
                    value = b"".join((head,))
            except TypeError:  # a chunk that does not stand for itself
                value = self.encode_whole(text)
            out.append(value)
        return out
