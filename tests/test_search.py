"""Ranking against brute force: BM25 in both plans, dense, hybrid, floors and caps."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskloom import lexicon as lx
from deskloom.operators import chunking as ch
from deskloom.operators import dense as dn
from deskloom.operators import lexical as lex
from deskloom.operators import search as se
from deskloom.session import cut_lineage
from deskloom.settings import SearchSettings

CHUNK = "chunk_id string, doc_ord long, chunk_no int, doc_id string, title string, url string, section string, text string"
WORDS = [f"w{i}" for i in range(60)]


def _corpus(seed=5, docs=40, hot=True):
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        for c in range(rng.randint(1, 4)):
            words = [rng.choice(WORDS) for _ in range(rng.randint(3, 25))]
            if hot and rng.random() < 0.5:
                words += ["hot"] * rng.randint(1, 4)
            rows.append((f"{d}#{c}", d, c, str(d), f"title{d % 5}", None, "", " ".join(words)))
    rows.append(("99#0", 99, 0, "99", "the", None, "", "of"))
    return rows


def _queries(seed=6, n=12):
    rng = random.Random(seed)
    out = [(f"q{i}", " ".join(rng.choice(WORDS + ["hot", "hot"]) for _ in range(rng.randint(1, 12)))) for i in range(n)]
    return out + [("blank", "   "), ("stop", "the of and"), ("none", "zzz")]


def _tokens(text):
    import re

    return [t for t in re.findall(lx.TOKEN_PATTERN, text.lower()) if t not in lx.STOPWORDS]


def _bm25(rows, text):
    docs = {(r[1], r[2]): _tokens(f"{r[4]}\n{r[7]}") for r in rows}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for toks in docs.values():
        for t in set(toks):
            df[t] = df.get(t, 0) + 1
    out = {}
    for key, toks in docs.items():
        s = 0.0
        for t in _tokens(text):
            f = toks.count(t)
            if f:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                s += idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * (len(toks) or 1) / avg))
        out[key] = s
    return out


def _rank(scores, floor, k=5):
    order = sorted(scores, key=lambda c: (-round(scores[c], 9), c))
    picked, per_doc = [], {}
    for c in order:
        if scores[c] < floor or per_doc.get(c[0], 0) >= 2:
            continue
        per_doc[c[0]] = per_doc.get(c[0], 0) + 1
        picked.append(c)
        if len(picked) == k:
            break
    return picked


@pytest.fixture(scope="module")
def data(spark):
    rows, queries = _corpus(), _queries()
    return (
        rows, queries, spark.createDataFrame(rows, CHUNK),
        spark.createDataFrame(queries, "query_id string, text string"),
    )


def _got(ranked):
    out = {}
    for r in ranked.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_ord, r.chunk_no))
    return out


@pytest.mark.parametrize("floor", [0.18, 0.35, 0.0, 0.3])
def test_lexical_ranking_matches_brute_force(data, floor):
    rows, queries, chunks, asked = data
    got = _got(se.search_lexical(asked, chunks, floor=floor))
    for q, text in queries:
        if not text.strip():
            assert q not in got
            continue
        scores = {c: s / (s + 16.0) if s > 0 else 0.0 for c, s in _bm25(rows, text).items()}
        assert got.get(q, []) == _rank(scores, floor), q


@pytest.mark.parametrize("depth", [None, 4, 20])
def test_scores_agree_with_brute_force(spark, data, depth, monkeypatch):
    rows, queries, chunks, asked = data
    monkeypatch.setattr(lex, "POSTINGS_PER_SALT", 7)
    terms = cut_lineage(lex.query_terms(asked))
    index = lex.build_index(chunks, terms)
    for frame in (lex.bm25_scores(terms, index, depth=depth),):
        got = {}
        for r in frame.collect():
            got.setdefault(r.query_id, {})[(r.doc_ord, r.chunk_no)] = r.bm25
        for q, text in queries:
            full = {c: s for c, s in _bm25(rows, text).items() if s > 0}
            best = sorted(full, key=lambda c: (-round(full[c], 9), c))[:depth]
            for c in best:
                assert got[q][c] == pytest.approx(full[c], abs=1e-9)
            assert all(v == pytest.approx(full[c], abs=1e-9) for c, v in got.get(q, {}).items())


@pytest.mark.parametrize("coded, space", [(7, 1 << 20), (7, 15 * 8), (1 << 16, 1 << 20)])
def test_chunks_travel_packed(spark, data, monkeypatch, coded, space):
    rows, queries, _, asked = data
    rows = rows + [(f"{d}#0", d, 0, str(d), "many", None, "", "hot " * 300 + f"w{d % 60}") for d in range(100, 103)]
    monkeypatch.setattr(lex, "CODED_TERMS", coded)
    monkeypatch.setattr(lex, "VOCABULARY_BYTES", space)
    terms = cut_lineage(lex.query_terms(asked))
    index = lex.build_index(spark.createDataFrame(rows, CHUNK), terms)
    frame = lex.bm25_scores(terms, index, depth=None)
    got = {(r.query_id, r.doc_ord, r.chunk_no): r.bm25 for r in frame.collect()}
    want = {(q, *c): s for q, text in queries for c, s in _bm25(rows, text).items() if s > 0}
    assert got == pytest.approx(want, abs=1e-9)
    codes = lex._codes(terms.select(F.xxhash64("term").alias("id"), F.lit(1).alias("df")).distinct())
    assert codes.whole == (space > 1 << 10) and len(codes.hashes) == min(space // 8, terms.select("term").distinct().count())
    batch = pa.RecordBatch.from_pydict({
        "chunk_block": pa.array([1, 0, 1], pa.int32()), "doc_ord": pa.array([5, 6, 7], pa.int64()),
        "chunk_no": pa.array([0, 1, 2], pa.int32()), "dl": pa.array([2, 1, 400], pa.int64()),
        "ids": pa.array([[codes.hashes[0], 99], [codes.hashes[1]], [codes.hashes[2]]], pa.list_(pa.int64())),
        "tfs": pa.array([[1, 1], [1], [400]], pa.list_(pa.int32())),
    })
    # One row a block, and terms that nobody asks for only where not all asked ones are known.
    packed = pa.Table.from_batches(lex._pack(SimpleNamespace(value=codes))(iter([batch])))
    assert packed["chunk_block"].to_pylist() == [0, 1]
    doc, no, dl, owner, ids, tf = lex._unpacked(packed, codes)
    postings = {(int(doc[o]), int(no[o]), int(dl[o]), int(i), int(f)) for o, i, f in zip(owner, ids, tf, strict=True)}
    a, b, c = (int(h) for h in codes.hashes[:3])
    assert postings == {(5, 0, 2, a, 1), (6, 1, 1, b, 1), (7, 2, 400, c, 400)} | (set() if codes.whole else {(5, 0, 2, 99, 1)})


def test_copies_stay_in_their_block(spark, data, monkeypatch):
    rows, queries, _, asked = data
    monkeypatch.setattr(lex, "POSTINGS_PER_BLOCK", 700)
    monkeypatch.setattr(lex, "QUERIES_PER_BLOCK", 5)
    text = next(r[7] for r in rows if r[1] == 3)
    rows = rows + [(f"{d}#0", d, 0, str(d), "title3", None, "", text) for d in range(200, 600)]
    chunks = spark.createDataFrame(rows, CHUNK)
    terms = cut_lineage(lex.query_terms(asked))
    index = lex.build_index(chunks, terms)
    blocks = -(-index.postings.count() // 700)
    left = lex.bm25_scores(terms, index, depth=5, per_document=2).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert left <= blocks * 5 * 2 < 400
    got = _got(se.search_lexical(asked, chunks, floor=0.18))
    for q, text in queries:
        scores = {c: s / (s + 16.0) if s > 0 else 0.0 for c, s in _bm25(rows, text).items()}
        assert got.get(q, []) == (_rank(scores, 0.18) if text.strip() else []), q


def test_what_blocks_return_does_not_grow_with_their_number(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"{d}#0", d, 0, str(d), "t", None, "", " ".join(rng.choices(WORDS, k=rng.randint(4, 20)))) for d in range(2000)]
    queries = [(f"q{i}", " ".join(rng.choices(WORDS, k=6))) for i in range(4)]
    asked = spark.createDataFrame(queries, "query_id string, text string")
    monkeypatch.setattr(lex, "POSTINGS_PER_BLOCK", 100)
    monkeypatch.setattr(lex, "PAIRS_PER_ROUND", 15)
    terms = cut_lineage(lex.query_terms(asked))
    index = lex.build_index(spark.createDataFrame(rows, CHUNK), terms)
    blocks = -(-index.postings.count() // 100)
    assert blocks > 60
    waves = lex._waves(blocks, 8)
    assert [a for a, _ in waves[1:]] == [b for _, b in waves[:-1]] and waves[-1][1] == blocks and len(waves) < 5
    frame = lex.bm25_scores(terms, index, depth=5, per_document=2)
    got = {}
    for r in frame.collect():
        got.setdefault(r.query_id, {})[(r.doc_ord, r.chunk_no)] = r.bm25
    for q, text in queries:
        full = {c: s for c, s in _bm25(rows, text).items() if s > 0}
        for c in sorted(full, key=lambda c: (-round(full[c], 9), c))[:5]:
            assert got[q][c] == pytest.approx(full[c], abs=1e-9)
        # Each block has five or more; those of the first wave bound the others.
        assert len(got[q]) < 2.5 * blocks
    # Copies of queries or chunks for one another's blocks are not shuffled.
    assert "CoGroups" not in frame._jdf.queryExecution().toString()


def test_vocabulary_counts_terms_and_chunks(data):
    rows, _, chunks, _ = data
    want = {}
    for r in rows:
        toks = _tokens(f"{r[4]}\n{r[7]}")
        for t in set(toks):
            df, n = want.get(t, (0, 0))
            want[t] = (df + 1, n + toks.count(t))
    table, n_chunks = lex.vocabulary(chunks)
    assert n_chunks == len(rows)
    assert {r.term: (r.df, r.occurrences) for r in table.collect()} == want


def test_hot_term_is_salted(spark, data, monkeypatch):
    _, _, chunks, asked = data
    terms = cut_lineage(lex.query_terms(asked))
    index = lex.build_index(chunks, terms)
    weighted = index.postings.withColumn("impact", F.lit(1.0))
    scored = lex._weigh(terms, weighted, F.lit(index.n_chunks))
    plain = lex.salted_join(weighted, scored).count()
    assert lex.salted_join(weighted, scored, per_salt=5).count() == plain


def test_term_counts(spark):
    frame = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],)], "t array<string>")
    got = [sorted((x.term, x.tf) for x in r.c) for r in frame.select(lex.term_counts(F.col("t")).alias("c")).collect()]
    assert got == [[("a", 1), ("b", 3), ("c", 1)], []]


def _vectors(seed=1, n=300, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    v = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, d))
    v[: n // 3] = v[0]  # a third of the corpus is one copy
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_dense_matches_brute_force_with_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(dn, "SLICE_ROWS", 20)
    monkeypatch.setattr(dn, "QUERY_BLOCK", 7)
    v, q = _vectors(), _vectors(2, 25)
    corpus = spark.createDataFrame([(i, 0, [float(x) for x in r]) for i, r in enumerate(v)], "doc_ord long, chunk_no int, vec array<float>")
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in r]) for i, r in enumerate(q)], "query_id string, vec array<float>")
    got = {}
    for r in dn.nearest(queries, corpus, 6, pivots=9).collect():
        got.setdefault(r.query_id, {})[r.doc_ord] = r.dense
    sims = np.maximum(q.astype("float32").astype(float) @ v.astype("float32").astype(float).T, 0)
    for i in range(len(q)):
        best = np.sort(sims[i])[::-1][:6]
        assert sorted(got[f"q{i}"].values(), reverse=True) == pytest.approx(best, abs=1e-5)


def test_vectors_travel_once_for_each_bin_not_for_each_cell(spark, monkeypatch):
    v = np.random.default_rng(4).normal(size=(200, 32))  # no cell can be skipped
    rows = [(i, 0, [float(x) for x in r]) for i, r in enumerate(v)]
    corpus = spark.createDataFrame(rows, "doc_ord long, chunk_no int, vec array<float>")
    queries = corpus.select(F.col("doc_ord").cast("string").alias("query_id"), "vec")
    probe, visited = dn._probe, []

    def counted(index, visits, *rest):
        visited.append(visits.groupBy("query_id").count().agg(F.max("count")).first()[0])
        return probe(index, visits, *rest)

    monkeypatch.setattr(dn, "SLICE_ROWS", 100)
    monkeypatch.setattr(dn, "_probe", counted)
    assert dn.nearest(queries, corpus, 5, pivots=40).count() == 200 * 5
    assert max(visited) <= 4


def test_queries_that_are_copies_of_corpus_vectors(spark):
    v = _vectors(8, 60, 64)
    rows = [(i, 0, [float(x) for x in v[i]]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "doc_ord long, chunk_no int, vec array<float>")
    queries = spark.createDataFrame([(str(i), r) for i, _, r in rows], "query_id string, vec array<float>")
    got = dn.nearest(queries, corpus, 5, pivots=12).collect()
    assert len(got) == 60 * 5
    assert max(r.dense for r in got) <= 1.0
    # The first 20 vectors are one copy: ties go to the earliest.
    assert sorted(r.doc_ord for r in got if r.query_id == "3") == [0, 1, 2, 3, 4]


def test_hybrid_matches_brute_force(spark, data):
    rows, queries, chunks, asked = data
    s = SearchSettings()
    cv, qv = _vectors(3, 41), _vectors(4, len(queries))
    vec_of = {r[1]: cv[r[1]] for r in rows if r[1] < 35}  # some documents have no vector
    chunk_vectors = spark.createDataFrame(
        [(r[1], r[2], [float(x) for x in vec_of[r[1]]]) for r in rows if r[1] in vec_of],
        "doc_ord long, chunk_no int, vec array<float>",
    )
    query_vectors = spark.createDataFrame(
        [(q, [float(x) for x in qv[i]]) for i, (q, _) in enumerate(queries)], "query_id string, vec array<float>"
    )
    got = {}
    for r in se.search_hybrid(asked, chunks, query_vectors, chunk_vectors).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score))
    for i, (q, text) in enumerate(queries):
        if not text.strip():
            assert q not in got
            continue
        lexical = {c: b / (b + 16.0) if b > 0 else 0.0 for c, b in _bm25(rows, text).items()}
        both = {}
        for c in lexical:
            d = max(0.0, float(vec_of[c[0]] @ qv[i])) if c[0] in vec_of else 0.0
            both[c] = s.dense_weight * d + (1 - s.dense_weight) * lexical[c]
        want = [both[c] for c in _rank(both, s.min_score)]
        assert [x for _, x in sorted(got.get(q, []))] == pytest.approx(want, abs=1e-5)


def test_index_is_one_row_a_chunk_in_files_with_the_tokens_of_tokenise(spark):
    texts = ["Kelvin İstanbul kelvin a.b/c", "the of and", "", "  ÄB-c d_e ΣΣ 9", "x " * 300]
    rows = [(f"{i}#0", i, 0, str(i), None if i == 4 else f"Title {i}", None, "Part" if i % 2 else "", t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, CHUNK)
    index = lex.build_index(chunks)
    assert index.counted.inputFiles() and index.n_chunks == len(rows)
    indexed = lex.indexed_text(F.col("title"), F.col("section"), F.col("text"))
    want = {r.doc_ord: r.t for r in chunks.select("doc_ord", lex.tokenise(indexed).alias("t")).collect()}
    got = {r.doc_ord: r for r in index.counted.collect()}
    for i, tokens in want.items():
        row = got.get(i)
        assert (dict(zip(row.terms, row.tfs)) if row else {}) == {t: tokens.count(t) for t in tokens}
        assert row is None or row.dl == len(tokens)
    assert index.avgdl == pytest.approx(sum(map(len, want.values())) / len(rows))
    words = spark.createDataFrame([("kelvin",), ("title",)], "term string")
    cut = lex.build_index(chunks, words)
    assert (cut.n_chunks, cut.avgdl) == (index.n_chunks, index.avgdl)
    assert {r.term for r in cut.postings.collect()} == {"kelvin", "title"}


def test_found_articles_are_broadcast_not_shuffled(spark, data):
    rows, _, _, _ = data
    articles = spark.createDataFrame([(r[1], r[3], r[4], None, r[7]) for r in rows], "doc_ord long, doc_id string, title string, url string, content string")
    ranked = spark.createDataFrame([("q", 1, 3, 0, 0.5, 0.5)], "query_id string, rank int, doc_ord long, chunk_no int, score double, lexical double")
    plan = se.with_passages_from(ranked, articles)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan.split("BroadcastHashJoin", 1)[1]


def test_only_ranked_chunks_are_shuffled(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = " ".join(f"{'word ' * 30}{i}." for i in range(60))
        articles = spark.createDataFrame([(d, str(d), "t", None, text) for d in range(30)], "doc_ord long, doc_id string, title string, url string, content string")
        whole = {(c.doc_ord, c.chunk_no): c.text for c in ch.chunk_documents(articles).collect()}
        keys = [(q, d, n) for q in ("a", "b") for d in (0, 3, 7) for n in (1, 4)] + [("a", 5, 0), ("c", 5, 0)]
        rows = [(q, i, d, n, 0.5, 0.5) for i, (q, d, n) in enumerate(keys)]
        ranked = spark.createDataFrame(rows, "query_id string, rank int, doc_ord long, chunk_no int, score double, lexical double")
        for most in (100, 3):  # broadcast, and shuffled
            monkeypatch.setattr(se, "BROADCAST_DOCUMENTS", most, raising=False)
            found = se.with_passages_from(ranked, articles)
            got = {(r.query_id, r.doc_ord, r.chunk_no, r.text) for r in found.collect()}
            assert got == {(q, d, n, whole[d, n]) for q, d, n in keys} and found.count() == len(keys)
            # A chunk meets its document's ranked numbers before it moves.
            plan = found._jdf.queryExecution().sparkPlan().toString()
            cut = plan[: plan.index("Generate")]
            assert "LeftSemi" in cut and "array_contains" in cut
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hybrid_query_cuts_texts_once_for_its_vectors(spark, monkeypatch):
    from catalog import search as cs

    seen = []
    monkeypatch.setattr(cs.se, "search_hybrid", lambda *a, **k: seen.append(a[3]) or se.take_ranked(
        spark.createDataFrame([("q", 1, 0, 0.5, 0.5, 0.5)], "query_id string, doc_ord long, chunk_no int, score double, dense double, lexical double"),
        SearchSettings()))
    cs.search_hybrid(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and seen[0].count() > 0


def test_terms_are_counted_as_the_tokens_are_found(spark):
    texts = ["The Kelvin K9 a/b.c-d_e a/b.c-d_e", "İx été of WORD word", "", "漢abc字"]
    rows = [(f"{i}#0", i, 0, str(i), "t", None, "", t) for i, t in enumerate(texts)]
    for keep in (None, frozenset(["word", "k9"])):
        counted = lex.counted_chunks(spark.createDataFrame(rows, CHUNK), keep)
        assert counted.schema["terms"].dataType.elementType.typeName() == "string"
        for r in counted.collect():
            tokens = _tokens(f"t\n{texts[r.doc_ord]}")
            want = {t: tokens.count(t) for t in tokens if keep is None or t in keep}
            assert (r.dl, dict(zip(r.terms, r.tfs, strict=True))) == (len(tokens), want)


def test_every_line_break_cuts_and_line_feeds_alone_cost_no_regex(spark):
    text = "one\r\ntwo\rthree\x0bfour\x0cfive\x1csix\x1dseven\x1eeight\x85nine ten eleven\ntwelve"
    rows = [(text,), ("one\ntwo",), (None,)]
    found = spark.createDataFrame(rows, "content string").select(ch.split_sections(F.col("content")).alias("s")).collect()
    assert [[s.body for s in r.s] for r in found] == [["\n".join("one two three four five six seven eight nine ten eleven twelve".split())], ["one\ntwo"], []]
