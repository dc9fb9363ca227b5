"""License notices in texts: MinHash bands over overlapping windows retrieve templates, exact
shingle containment verifies them. Column expressions and joins only.

A window holds ``WINDOW_WORDS`` words and starts every half of that, so every notice of up to half
a window lies whole within one. Words are lower-cased runs without marks or white space. Of each
window and template the ``SHINGLE``-word shingles are hashed; a band is the smallest hash under one
permutation. A template that a window contains holds at least s = (its shingles) / (shingles of the
window) of their union, so with ``BANDS`` bands of one row each it is missed with probability
(1 - s) ** BANDS. Each template has windows of twice its length or up to an eighth more, whatever that
length is. So s is 3 of 8 shingles for a whole notice of five words, and never less than 4 of 13, for a
notice of seven words with one shingle wrong: (9 / 13) ** 32 is 1 in 128 000. Windows that share no
shingle with any template cannot collide and are put aside first, which loses nothing.

A retrieved template is reported where the window holds at least ``CONTAINED`` of its shingles
exactly. A notice in two overlapping windows counts once.

Null or empty text: no notice. A row without a notice is not in the result. Null ids stay null and
count as one document; repeated ids are one document. Further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deskloom.llm.common import pick

SHINGLE = 3
BANDS = 32
CONTAINED = 0.8
#: What stands between words.
BETWEEN = r"[\p{Punct}\s“”‘’«»]+"
#: The same for Python.
_BETWEEN = r"[!-/:-@\[-`{-~\s“”‘’«»]+"

# The customary notices of common licenses.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0",),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License",
    ),
    "GPL-2.0": (
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either"
        " version 2 of the License",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}


def _size(n_words: int) -> int:
    """Words of a template's windows: twice its own, in steps of 2 up to 32 and of an eighth to a sixteenth above."""
    twice = max(2 * n_words, 2 * SHINGLE)
    step = max(2, 1 << (twice - 1).bit_length() - 4)
    return -(-twice // step) * step


#: Words of the windows of the fixed templates.
SIZES = tuple(sorted({_size(len([w for w in re.split(_BETWEEN, t) if w])) for ts in TEMPLATES.values() for t in ts}))


def _hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), BETWEEN), ""), lambda w: F.xxhash64(w))


def _shingles(hashes: Column) -> Column:
    n = F.greatest(F.size(hashes) - (SHINGLE - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(hashes, k + 1, n).alias(f"w{k}") for k in range(SHINGLE)])
    return F.transform(zipped, lambda s: F.xxhash64(*[s[f"w{k}"] for k in range(SHINGLE)]))


def _minima(shingles: Column) -> Column:
    def low(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(k))))

    return F.array(*[low(k) for k in range(BANDS)])


def _places(shingles: Column, size: int) -> Column:
    """Size and first shingle of the windows of one size."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(shingles), F.lit(1)), F.lit(size // 2))
    return F.transform(starts, lambda at: F.struct(F.lit(size).alias("size"), at.alias("at")))


def templates(spark: SparkSession, notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """template, license, size (words of its windows), shingles (distinct), of a fixed small table."""
    rows = [
        (n, name, text)
        for n, (name, text) in enumerate((k, t) for k, ts in (notices or TEMPLATES).items() for t in ts)
    ]
    table = spark.createDataFrame(rows, "template int, license string, notice string")
    hashed = table.select("template", "license", _hashes(F.col("notice")).alias("words"))
    lengths = sorted({r.n for r in hashed.select(F.size("words").alias("n")).collect()})
    size = F.lit(_size(lengths[-1]) if lengths else SIZES[-1])
    for n in reversed(lengths[:-1]):
        size = F.when(F.size("words") <= n, F.lit(_size(n))).otherwise(size)
    return hashed.select("template", "license", size.alias("size"), F.array_distinct(_shingles(F.col("words"))).alias("shingles"))


def license_notices(docs: DataFrame, notices: dict[str, tuple[str, ...]] | None = None, *, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """doc_id, license, containment (percent of the best template), n_windows of each document and
    license that it carries a notice of."""
    known = templates(docs.sparkSession, notices)
    # The templates are a fixed table of this module or of the caller, a few hundred hashes.
    fixed = known.collect()
    any_template = F.array(*[F.lit(h) for r in fixed for h in r.shingles])
    sizes = sorted({r["size"] for r in fixed})
    own = pick(docs, doc_id=doc_id, text=text).select("doc_id", _hashes(F.col("text")).alias("words"))
    sets = own.select("doc_id", _shingles(F.col("words")).alias("shingles"))
    # A window of s words has s - SHINGLE + 1 shingles. The outer explode keeps the expressions above
    # it from being worked out once more in a filter below.
    windows_of = F.flatten(F.array(*[_places(F.col("shingles"), size) for size in sizes]))
    placed = sets.select(
        "doc_id", "shingles",
        F.explode_outer(F.when(F.arrays_overlap("shingles", any_template), windows_of)).alias("place"),
    ).filter(F.col("place").isNotNull())
    windows = placed.select(
        "doc_id", "place.size", "place.at",
        F.array_distinct(
            F.slice("shingles", F.greatest("place.at", F.lit(1)), F.greatest(F.col("place.size") - (SHINGLE - 1), F.lit(0)))
        ).alias("window"),
    )
    banded = windows.select(
        "doc_id", "size", "at", "window",
        F.posexplode_outer(F.when(F.arrays_overlap("window", any_template), _minima(F.col("window")))).alias("band", "low"),
    )
    by_band = known.select(
        "template", F.col("size").alias("t_size"), F.posexplode(_minima(F.col("shingles"))).alias("t_band", "t_low")
    )
    meets = (F.col("size") == F.col("t_size")) & (F.col("band") == F.col("t_band")) & (F.col("low") == F.col("t_low"))
    # One row for each window and template that collide, whatever the number of bands.
    retrieved = banded.join(F.broadcast(by_band), meets).groupBy("doc_id", "size", "at", "template").agg(
        F.first("window").alias("window")
    )
    whole = known.select("template", "license", F.col("shingles").alias("of_template"))
    shared = F.size(F.array_intersect("window", "of_template")) / F.size("of_template")
    verified = retrieved.join(F.broadcast(whole), "template").withColumn("share", shared).filter(F.col("share") >= CONTAINED)
    return verified.groupBy("doc_id", "license").agg(
        F.round(100 * F.max("share")).cast("int").alias("containment"), F.countDistinct("size", "at").alias("n_windows")
    )
