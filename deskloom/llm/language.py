"""Language of whole texts by a byte convolutional network.

Filters of several widths run over embedded bytes, the maximum of each over a window goes through a
rectifier into a softmax. The network is trained in numpy on windows of labelled texts: at most
about ``PER_LANG`` documents of each language, picked by a hash of their id, ``EXCERPTS`` windows
from each (the documented bound of the sample). Prediction reads every window of every text in
batches and averages the windows' probabilities, weighted by their letters. Case is folded.

Null text or no letter: ``und`` with score 0. A null id counts as held out. Rows without a language
are predicted, but not learned from. Without any labelled row every text is ``und``. Ids may repeat;
each row is predicted on its own. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from deskloom.llm.chunks import forget
from deskloom.llm.common import pick, text_buffers, text_slices

UNKNOWN = "und"
WINDOW = 96
WIDTHS = (2, 3, 4, 5)
EMBED, FILTERS = 8, 16
PER_LANG, EXCERPTS = 1500, 4
EPOCHS, BATCH, RATE = 8, 128, 0.004
#: Windows whose filters are worked out at once.
TOGETHER = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (max width * EMBED, filters of all widths); zero below a narrow filter
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, max width * EMBED)"""
        x = self.embed[np.pad(windows, ((0, 0), (0, WIDTHS[-1] - 1)))]
        return np.concatenate([x[:, i : i + windows.shape[1]] for i in range(WIDTHS[-1])], axis=2)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = self.columns(windows)
        response = (columns.reshape(-1, columns.shape[2]) @ self.filters).reshape(*columns.shape[:2], -1)
        at = response.argmax(axis=1)
        top = np.take_along_axis(response, at[:, None], axis=1)[:, 0] + self.bias
        return columns, at, np.maximum(top, 0)

    def top(self, windows: np.ndarray) -> np.ndarray:
        columns = self.columns(windows)
        response = (columns.reshape(-1, columns.shape[2]) @ self.filters).reshape(*columns.shape[:2], -1)
        return np.maximum(response.max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [
            _softmax(self.top(windows[a : a + TOGETHER]) @ self.out + self.out_bias)
            for a in range(0, len(windows), TOGETHER)
        ]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case: ASCII, and the Latin letters after 0xC3."""
    out = _LOWER[data]
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    out[1:][capital] += 0x20
    return out


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover the texts end to end, the last of each padded, and their texts."""
    count = -(-np.diff(offsets) // WINDOW)
    owner = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][owner] + nth * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][owner][:, None]
    out = np.zeros(at.shape, np.uint8)
    out[inside] = data[at[inside]]
    return out, owner


def train(texts: list[str], labels: list[str], seed: int = 7) -> Network:
    """Plain back-propagation with Adam; classes weigh the same whatever their number of rows."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    windows, owner = windows_of(fold(data), offsets)
    y = np.searchsorted(languages, np.array(labels))[owner]
    n, classes, total = len(windows), len(languages), FILTERS * len(WIDTHS)
    weight = (n / classes / np.bincount(y, minlength=classes))[y].astype(np.float32)
    mask = np.zeros((WIDTHS[-1] * EMBED, total), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
    net = Network(
        languages, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(total, np.float32),
        rng.normal(0, 0.2, (total, classes)).astype(np.float32), np.zeros(classes, np.float32),
    )
    params = ["embed", "filters", "bias", "out", "out_bias"]
    m = {p: np.zeros_like(getattr(net, p)) for p in params}
    v = {p: np.zeros_like(getattr(net, p)) for p in params}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            rows = order[a : a + BATCH]
            x = windows[rows]
            columns, at, top = net.pooled(x)
            wrong = _softmax(top @ net.out + net.out_bias)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            wrong *= weight[rows, None] / len(rows)
            back = (wrong @ net.out.T) * (top > 0)  # (rows, filters)
            seen = columns[np.arange(len(rows))[:, None], at]  # (rows, filters, width * EMBED)
            to_columns = back[:, :, None] * net.filters.T[None]
            embed = np.zeros_like(net.embed)
            padded = np.pad(x, ((0, 0), (0, WIDTHS[-1] - 1)))
            for i in range(WIDTHS[-1]):
                byte = padded[np.arange(len(rows))[:, None], at + i]
                np.add.at(embed, byte, to_columns[:, :, i * EMBED : (i + 1) * EMBED])
            grads = {
                "embed": embed, "filters": np.einsum("rf,rfk->kf", back, seen) * mask, "bias": back.sum(axis=0),
                "out": top.T @ wrong, "out_bias": wrong.sum(axis=0),
            }
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p in params:
                m[p] = 0.9 * m[p] + 0.1 * grads[p]
                v[p] = 0.999 * v[p] + 0.001 * grads[p] ** 2
                setattr(net, p, (getattr(net, p) - rate * m[p] / (np.sqrt(v[p]) + 1e-8)).astype(np.float32))
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        per_lang: int = PER_LANG) -> Network | None:
    """The network, learned from labelled documents that are not held out; None without any."""
    own = pick(docs, doc_id=doc_id, text=text, lang=lang).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return None
    # A share of each language by a hash of the id, so that about per_lang rows of each come.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n))])
    starts = [
        F.substring(
            "text",
            (1 + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - WINDOW, F.lit(1)))).cast("int"),
            F.lit(WINDOW),
        )
        for k in range(EXCERPTS)
    ]
    rows = own.filter(place < share[F.col("lang")]).select("doc_id", "lang", F.array(*starts).alias("parts")).collect()
    found = sorted((r["doc_id"], r["lang"], part) for r in rows for part in r["parts"] if any(map(str.isalpha, part)))
    if not found:
        return None
    return train([t for _, _, t in found], [lang for _, lang, _ in found])


def scores(net: Network | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of a column."""
    n = len(texts)
    names, best = np.full(n, UNKNOWN, object), np.zeros(n)
    letters = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(False)
    data, offsets = text_buffers(texts)
    whole = pa.RecordBatch.from_arrays([texts], ["text"])
    for a, b in text_slices(whole, "text", 1 << 19) if net is not None else ():
        if offsets[b] == offsets[a]:
            continue
        windows, owner = windows_of(fold(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
        weight = _LETTER[windows].sum(axis=1).astype(np.float64)
        total = np.zeros((b - a, len(net.languages)))
        np.add.at(total, owner, net.probabilities(windows) * weight[:, None])
        known = np.flatnonzero(letters[a:b])
        names[a + known] = np.array(net.languages, object)[total[known].argmax(axis=1)]
        best[a + known] = np.clip(total[known].max(axis=1) / np.maximum(total[known].sum(axis=1), 1e-12), 0, 1)
    return names, best


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            names, best = scores(net, batch.column("text"))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                    "lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(best),
                }
            )

    return run


def predict(docs: DataFrame, net: Network | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row's whole text."""
    own = pick(docs, doc_id=doc_id, text=text).withColumn("held_out", held_out(F.col("doc_id")))
    return own.mapInArrow(_predict(net), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows and predict all."""
    return predict(docs, fit(docs))


def keep_known(docs: DataFrame, net: Network | None, *, min_score: float, text: str = "text") -> DataFrame:
    """The rows, all columns, whose language is found with at least ``min_score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            names, best = scores(net, batch.column(batch.schema.get_field_index(text)))
            yield batch.filter(pa.array((names != UNKNOWN) & (best >= min_score)))

    return docs.mapInArrow(run, docs.schema)
