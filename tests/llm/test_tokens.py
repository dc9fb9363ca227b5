import gc
import hashlib
import os
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from deskloom.llm import chunks, pieces, token_ids
from llm.conftest import ODD

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "aeiorstnhEN 's\n\t.,é▁☃日1"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1600))
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    starts, body = token_ids.pack_blocks(ids)
    assert token_ids.unpack_blocks(starts, body, len(ids)).tolist() == values


def test_outliers_are_exceptions():
    ids = np.full(token_ids.BLOCK, 100, np.uint32)
    ids[7] = 2**31
    starts, body = token_ids.pack_blocks(ids)
    assert len(body) == 7 + 6  # header and one exception; no packed bits


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        token_ids.read_shard(b"nothing of the kind" * 9)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=60), max_size=8))
def test_encoders_equal_the_libraries(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    whole.encode_special_tokens = True
    own = token_ids.encoder(BPE, 0)(texts)
    assert [np.frombuffer(o, "<u4").tolist() for o in own] == [
        whole.encode(t, add_special_tokens=False).ids for t in texts
    ]
    model, _ = pieces.model(PIECE)
    assert pieces.encode(texts, PIECE) == [model.library.encode(t) + [2] for t in texts]


def test_agendas_in_step_and_by_heap_agree():
    model, _ = pieces.model(PIECE)
    chunks = ["▁" + w for w in ("international", "☃snow☃", "aaaaaaaaaaa", "of.\nErtion", "x", "日本語")]
    assert model.encode_chunks(chunks) == [model._by_heap(c) for c in chunks]


def test_known_chunks_are_thinned():
    from deskloom.llm.chunks import ChunkEncoder

    own = ChunkEncoder(lambda chunks, first, known: [c.encode() for c in chunks], str.encode, limit=100)
    for n in range(30):
        assert own([f"a bb chunk-of-many-letters-{n}"]) == [f"abbchunk-of-many-letters-{n}".encode()]
        assert own.held < 400


def test_token_id_files(docs, spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    whole.encode_special_tokens = True
    got = token_ids.token_id_files(docs(ODD), BPE).collect()
    assert len(got) == len(ODD)
    start = 0
    by_start = sorted(got, key=lambda r: r.start)
    expected = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    for row, (doc_id, text) in zip(by_start, expected):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_ids.token_id_files(docs([]), BPE).collect() == []


def test_shards_hold_whole_documents(docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_ids, "SHARD_TOKENS", 50)
    run = token_ids._shards(BPE, 0)

    class Context:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(token_ids.TaskContext, "get", lambda: Context)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3]), "text": pa.array(["a b " * 40, "c", "d e"])})
    shards = [b.to_pylist()[0] for b in run(iter([batch]))]
    assert [s["n_docs"] for s in shards] == [1, 2]
    assert shards[1]["start_in_part"] == shards[0]["n_tokens"]


def test_sentencepiece_documents(docs):
    model, _ = pieces.model(PIECE)
    got = sorted(pieces.encoding_digests(docs(ODD), PIECE).collect(), key=str)
    expected = []
    for doc_id, text in ODD:
        ids = model.library.encode(text or "") + [2]
        joined, back = " ".join(map(str, ids)), model.library.decode(ids)
        expected.append((doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (joined, back))))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    full = {r.doc_id: r for r in pieces.encode_documents(docs(ODD), PIECE).collect()}
    assert full[10].decoded == "a b c" and full[10].ids[-1] == 2
    assert pieces.encoding_digests(docs([]), PIECE).collect() == []


def test_words_encoded_together_and_forgotten_tables():
    """Words of every script, alone, first and after a space, as the library encodes them; also after ``forget``."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from deskloom.llm import chunks, token_ids

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, plain = token_ids.encoder(path, 0), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = ["", "one", "Über naïve ñandú 漢字 слово", "a\nb \n c  d", "endoftext <|endoftext|> Ċ Ġ Ċord", "word, word. word! ÿÿ"]
    texts += [" ".join(f"w{chr(97 + i % 26)}{'éß漢'[i % 3]}{i}" for i in range(50_000))]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == want
    chunks.forget()
    assert encode.held == 0 and not encode.later
    assert encode(texts) == want


def test_digests_do_not_depend_on_the_chunks_that_are_kept(spark):
    from deskloom.llm import pieces
    from deskloom.llm.queries import tokenizer_file

    docs = spark.createDataFrame([(i, f"word{i} and more words {i * 7} again") for i in range(50)], "doc_id long, text string")
    few, many = (
        {tuple(r) for r in pieces.encoding_digests(docs, tokenizer_file("piece_bpe_32k.model"), **kept).collect()}
        for kept in ({"known_chars": 50}, {})
    )
    assert few == many and len(few) == 50


def test_forgotten_memory_goes_back_to_the_system():
    # Freed blocks below one that is in use stay with the process unless they are given back.
    code = """
import numpy
from deskloom.llm import chunks
def own():
    return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")) / 1e3
held = [bytes(4000) for _ in range(25_000)]
last = held[-1]
del held
before = own()
chunks.forget()
print(before - own())
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": os.pathsep.join(sys.path)})
    assert float(said.stdout) > 50


def test_the_collector_rests_while_texts_are_encoded():
    rested = []

    def encode_new(chunks, first, known):
        rested.append(gc.isenabled())
        return [c.encode() for c in chunks]

    encoder = chunks.ChunkEncoder(encode_new, str.encode)
    assert encoder(["a b", "b c"]) == [b"ab", b"bc"] and rested == [False, False] and gc.isenabled()
    with pytest.raises(ZeroDivisionError):
        chunks.ChunkEncoder(lambda *a: 1 / 0, str.encode)(["a"])
    assert gc.isenabled()
