"""What the operators share: inputs under private names, the shared folder, Arrow text batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from deskloom.session import cut_lineage

#: Text bytes that the numpy code holds at once; a longer text is taken in pieces by its operator.
BLOCK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that further ones cannot clash."""
    return df.select(*[F.col(f"`{name}`").alias(own) for own, name in columns.items()])


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    spark.sparkContext  # noqa: B018
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        cut_lineage(spark.range(1))  # sets a folder where none is named
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def text_slices(batch: pa.RecordBatch, column: str, block: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of the batch whose texts hold about ``block`` bytes; a longer text stands alone."""
    offsets = text_buffers(batch.column(column))[1]
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + block, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null counts as no bytes."""
    wide = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if wide.null_count:
        wide = wide.fill_null("")
    _, offsets, data = wide.buffers()
    offsets = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage is cut, columns stay small."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a key filter at most.
MAX_BITS = 1 << 29


def key_filter(keys: DataFrame, per_key: int = 16) -> np.ndarray:
    """Bitmap with one bit set for each ``key`` (long): ``per_key`` bits or more a key, 64 MB at most.

    A second pass over the texts uses it to leave out what cannot match; what it lets through by
    chance is for an exact join to drop. The keys are written down once, as they are read twice.
    """
    stored = kept(keys.select("key"), "keys")
    bits = int(min(max(stored.count(), 1) * per_key, MAX_BITS) - 1).bit_length()
    bits = max(bits, 10)
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    found = stored.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy(
        "word"
    ).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def admits(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (64 bits, unsigned) may be one of the filter's."""
    at = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
