"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from deskloom.llm import word_bpe
from deskloom.llm.queries import tokenizer_file

from .conftest import ODD

FILE = tokenizer_file("byte_bpe_50k.tiktoken")
TEXTS = [
    *(t for _, t in ODD), "  two  spaces   three ", "\n\n a \n b\n  c\r\n", " lead", "trail ", "tab\tand nbsp  em",
    "I'm we'll 'tis don'T", "12345 ٣٤٥ ²³", "aaaa" * 300, "word" * 700 + " x", "ﷺ 😀😀👩‍👩‍👧 \U0001e4d0\U0001e4d1 ࡰࡱx",
    "<|endoftext|> a", "日本語の文章です。" * 30, "\u0085 x᠎ y", "é ẞ \x00\x01",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=word_bpe.load_ranks(FILE), special_tokens={})


def test_ids_and_texts_as_the_library(docs, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, "again"), (1, "again"), (None, "no id")]
    found = word_bpe.encode_documents(docs(rows), FILE).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    plain = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in found), key=key) == sorted(plain, key=key)


def test_the_size_of_the_table_changes_no_result(docs, library):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)]
    for known in (1, 5, 1000):
        for r in word_bpe.encoding_digests(docs(rows), FILE, known_words=known).collect():
            ids = library.encode_ordinary(rows[r.doc_id][1] or "")
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id][1] or "").encode()).hexdigest()


def test_fold_in_columns(spark, library):
    codec = word_bpe.WordCodec(FILE)
    rnd = random.Random(2)
    words = [" hello", "a", "é", " unbelievably", "日本", "x" * 40, "'s", " Straßenbahn"]
    words += ["".join(rnd.choice("abcdetion") for _ in range(rnd.randrange(1, 20))) for _ in range(60)]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for r in frame.select("word", codec.ranks.bound(lambda ranks: codec.fold(F.col("word"), ranks)).alias("ids")).collect():
        assert list(r.ids) == library.encode_ordinary(r.word), r.word


def test_merges_with_and_without_a_heap(library):
    ranks, rnd = word_bpe.load_ranks(FILE), random.Random(5)
    for n in (1, 2, 10, 47, 48, 49, 400, 3000):
        word = "".join(rnd.choice("aabcnioe") for _ in range(n))
        assert word_bpe.merge(word.encode(), ranks) == word_bpe._merge_with_heap(word.encode(), ranks) or word.encode() in ranks
        assert word_bpe.merge(word.encode(), ranks) == library.encode_ordinary(word)


def test_empty_table(docs):
    assert word_bpe.encoding_digests(docs([]), FILE).collect() == []
