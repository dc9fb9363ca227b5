"""The pipeline's stages and result against plain Python."""

import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from deskloom.llm import language
from llm.test_pairs import roots, shingles_of
from llm.test_scans import language_rows, plain_secrets


def test_pipeline(docs, spark, tmp_path):
    leak = "which of these three was the first to be found in the great hall of the old northern castle"
    rows = language_rows(80)
    rows += [(200, rows[4][1], rows[4][2]), (201, rows[5][1] + " ", None), (202, "12 ## 34", "en"), (203, None, "de")]
    rows += [(204, rows[6][1] + "\n" + leak + ".", "en"), (205, language_rows(1, seed=99)[0][1] + " password=b7db7aa4a5fcc78305", "en")]
    for name, frame in (("documents", docs(rows)), ("benchmark", spark.createDataFrame([(1, leak)], "item_id long, text string"))):
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    # A plain version of the stages, with the network's verdict taken from the network.
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in language.identify(table).collect()}
    kept = [(i, t) for i, t, *_ in rows if found[i].lang_pred != "und" and found[i].score >= corpus_pipeline.MIN_SCORE]
    sets = {i: shingles_of(t, 5) for i, t in kept}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    root = roots(sets, links)
    kept = [(i, t) for i, t in kept if root[i] == i and leak not in t]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = []
    for i, t in kept:
        for _, a, b in plain_secrets(t):
            t = t[:a] + "*" * (b - a) + t[b:]
        ids = library.encode(t) + [2]
        expected.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids)))))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == sorted(expected)
    ids = {r[0] for r in got}
    assert 205 in ids and not ids & {200, 202, 203, 204}


def test_stages_keep_the_columns(docs, spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = docs(language_rows(40))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns


def test_near_duplicates_by_five_words(docs, spark, tmp_path):
    """Two texts with a 5-word index of 0.82 and a 4-word one under 0.85 are near duplicates."""
    words = [f"word{i}" for i in range(104)]
    texts = [" ".join(words), " ".join(words[:50] + ["other"] + words[51:] + [f"more{i}" for i in range(10)])]
    a, b = (shingles_of(t, 5) for t in texts)
    assert 0.81 <= len(a & b) / len(a | b) < 0.83
    a, b = (shingles_of(t, 4) for t in texts)
    assert len(a & b) / len(a | b) < 0.85
    rows = [(1, texts[0]), (2, texts[1]), (3, " ".join(reversed(words)))]
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs(rows), str(tmp_path)).collect()} == {1, 3}


def test_near_duplicates_of_repeated_ids(docs, spark, tmp_path):
    """Rows are judged by id and text: no text is lost with its id, and of equal rows one stays."""
    a, z, q = (" ".join(f"{c}{i}" for i in range(30)) for c in "azq")
    rows = [(1, a), (5, a), (5, z), (7, q), (7, q), (7, q + " "), (8, ""), (8, ""), (None, a), (None, a)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs(rows), str(tmp_path)).collect()]
    sevens = [t for i, t in got if i == 7]
    assert len(sevens) == 1 and sevens[0].strip() == q
    assert sorted((x for x in got if x[0] != 7), key=str) == sorted(
        [(1, a), (5, z), (8, ""), (8, ""), (None, a), (None, a)], key=str
    )
    assert corpus_pipeline.one_of_each(spark, docs([]), str(tmp_path)).collect() == []
