"""Python functions of one row whose exceptions become a column instead of ending the job."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string


def guarded(fn: Callable, returns: str, *inputs: Column) -> Column:
    """Struct of ``value`` (``fn`` of the row's inputs, of type ``returns``) and ``problem``.

    A row whose call raises has a null value and ``Type: message`` as its problem; the others of its
    Arrow batch are not touched. Inputs arrive as Python values, nulls as None.
    """
    schema = StructType([StructField("value", _parse_datatype_string(returns)), StructField("problem", StringType())])

    @F.pandas_udf(schema)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.astype(object).where(rows.notna(), None).itertuples(index=False):
            try:
                out.append((fn(*row), None))
            except Exception as problem:  # noqa: BLE001 - whatever it is, only this row has it
                out.append((None, f"{type(problem).__name__}: {problem}"))
        return pd.DataFrame(out, columns=["value", "problem"], dtype=object)

    return run(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(inputs)]))


def with_guarded(rows, name: str, fn: Callable, returns: str, *inputs: Column):
    """Adds ``name``, and joins what went wrong to the column ``problem`` (the first problem of a row stays)."""
    before = F.col("problem") if "problem" in rows.columns else F.lit(None).cast("string")
    return (
        rows.withColumn("_guarded", guarded(fn, returns, *inputs))
        .withColumn("problem", F.coalesce(before, F.col("_guarded.problem")))
        .withColumn(name, F.col("_guarded.value"))
        .drop("_guarded")
    )
