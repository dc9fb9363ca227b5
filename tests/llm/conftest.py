import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    # A column that an operator may use by itself.
    + [T.StructField(n, T.StringType()) for n in ("part", "lang", "source", "words")]
)


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with further columns from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "x", r[2] if len(r) > 2 else None, "y", None) for r in rows]
        frame = spark.createDataFrame(full, DOCS)
        return frame.repartition(parts) if rows else frame

    return make


ODD = [
    (1, ""), (2, None), (3, " "), (4, "a  b \n c\t"), (5, "word " * 3000), (6, "x" * 5000), (7, "▁a ▁ b"),
    (8, "don't it's 's 't.. ,,"), (9, "日本語 ☃ é ñ \x00"), (10, "a b c"), (10, "a b c"), (None, "no id here"),
]
