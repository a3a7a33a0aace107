"""Index, retrieval, fusion, reranking, metrics."""

import math

import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from trovelle.functions import text as T
from trovelle.operators import index, metrics, rerank, retrieve
from trovelle.plans import text_queries
from trovelle.plans.pipeline import OUT_OF_SCOPE, AskConfig, ask, evaluate

CHUNK = "chunk_id string, document_id string, title string, section string, page int, text string"
ROWS = [
    ("c0", "d0", "Asthma care", "Body", 1, "Inhaled steroid lowers asthma attacks in adults."),
    ("c1", "d1", "Gout care", "Body", 1, "Allopurinol lowers urate in gout patients over months."),
    ("c2", "d2", "Migraine care", "Body", 1, "Triptan relieves migraine within two hours in adults."),
    ("c3", "d3", "Noise", "Body", 1, "urate urate urate urate urate urate"),
    ("c4", "d3", None, None, None, None),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, CHUNK)


def ask_of(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, question string")


def brute(query: str) -> dict:
    import re

    tok = {r[0]: [w for w in re.findall("[a-z0-9]+", " ".join(x for x in (r[2], r[3], r[5]) if x).lower()) if w not in T.STOPWORDS] for r in ROWS}
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok)
    terms = list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", query.lower()) if w not in T.STOPWORDS))
    out = {}
    for c, words in tok.items():
        s, m = 0.0, 0
        for t in terms:
            df, tf = sum(t in w for w in tok.values()), words.count(t)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
                m += 1
        if s:
            out[c] = s * m / len(terms)
    return out


def test_bm25_matches_brute_force_and_wants_coordination(spark, chunks):
    asked = ask_of(spark, "urate in gout patients", "unheardof", None, "asthma adults unheardof", "")
    got = retrieve.bm25(chunks, asked, 3).collect()
    for q, text in (("q0", "urate in gout patients"), ("q3", "asthma adults unheardof")):
        want = sorted(brute(text).items(), key=lambda x: (-round(x[1], 9), x[0]))[:3]
        have = [(r.chunk_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert [h[0] for h in have] == [w[0] for w in want] and all(abs(h[1] - w[1]) < 1e-9 for h, w in zip(have, want))
    assert {r.query_id for r in got} == {"q0", "q3"}
    assert next(r.chunk_id for r in got if r.query_id == "q0" and r.rank == 1) == "c1"


def test_bm25_over_nothing(spark, chunks):
    assert retrieve.bm25(chunks.where("false"), ask_of(spark, "urate"), 3).count() == 0
    assert retrieve.bm25(chunks, ask_of(spark, "urate").where("false"), 3).count() == 0


def test_empty_passages_count_in_the_lengths(spark, chunks):
    r = index.corpus_stats(index.tokens(chunks)).first()
    assert r.n == 5 and r.avgdl == pytest.approx(sum(len(v) for v in [[]]) + index.tokens(chunks).agg(F.avg("dl")).first()[0])


def test_vector_search_is_exact_and_breaks_ties_by_id(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    rows = [(i, [float(x) for x in v[i]]) for i in range(40)] + [(99, None), (98, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = retrieve.vector(df, "id", "v", df.where("id < 5"), "id", "v", 5).orderBy("query_id", "rank").collect()
    f = np.array([np.float32(x) for x in v]).astype(float)
    for q in range(5):
        s = np.round(f @ f[q], 9)
        assert [r.id for r in got if r.query_id == q] == sorted(range(40), key=lambda i: (-s[i], i))[:5]
    assert retrieve.vector(df.where("false"), "id", "v", df.where("id < 5"), "id", "v", 5).count() == 0
    assert retrieve.vector(df, "id", "v", df.where("false"), "id", "v", 5).count() == 0
    other = retrieve.vector(df, "id", "v", df.where("id = 3"), "id", "v", 1, keep_self=False).first()
    assert other.id == 7


def lists(spark):
    s = "query_id string, chunk_id string, score double, rank int"
    return spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2), ("q", "c", 0.1, 3)], s), spark.createDataFrame([("q", "b", 7.0, 1), ("q", "d", 7.0, 2)], s)


def test_fusion(spark):
    dense, lex = lists(spark)
    got = [(r.chunk_id, r.score) for r in retrieve.rrf(dense, lex).orderBy("rank").collect()]
    assert [g[0] for g in got] == ["b", "a", "d", "c"] and got[0][1] == pytest.approx(1 / 62 + 1 / 61)
    got = {r.chunk_id: r.score for r in retrieve.weighted(dense, lex).collect()}
    assert got == pytest.approx({"b": 0.5 * 0.875 + 0.5, "d": 0.5, "a": 0.5, "c": 0.0})
    with pytest.raises(ValueError):
        retrieve.retrieve("nearest", None, None)
    r = retrieve.arm_overlap(dense, lex).first()
    assert (r.first_only, r.shared, r.second_only, r.jaccard) == (2, 1, 1, 0.25)


def test_quota_backfills_and_zero_is_a_score(spark):
    s = "query_id string, chunk_id string, document_id string, rank int, score double, question string, title string, section string, text string, fixed double"
    rows = [("q", f"c{i}", "d0" if i < 4 else "d1", i + 1, 1.0, "x", None, None, "x", 10.0 - i if i < 4 else 0.1) for i in range(5)]
    df = spark.createDataFrame(rows, s)
    got = [r.chunk_id for r in rerank.rerank(df, 3, 2, lambda: F.col("fixed")).orderBy("rank").collect()]
    assert got == ["c0", "c1", "c4"]
    assert [r.chunk_id for r in rerank.rerank(df, 4, 2, lambda: F.col("fixed")).orderBy("rank").collect()] == ["c0", "c1", "c4", "c2"]
    assert [r.chunk_id for r in rerank.rerank(df, 3, 0, lambda: F.col("fixed")).orderBy("rank").collect()] == ["c0", "c1", "c2"]
    zero = rerank.rerank(df.where("chunk_id in ('c0', 'c4')"), 2, 2, lambda: F.when(F.col("chunk_id") == "c0", -1.0).otherwise(0.0)).orderBy("rank").collect()
    assert [r.chunk_id for r in zero] == ["c4", "c0"] and zero[0].retriever == "hybrid+rerank"


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3)], "query_id string, item_id string, rank int")
    rel = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("none", "z")], "query_id string, item_id string")
    got = {r.query_id: r for r in metrics.per_query(ranked, rel).collect()}
    q = got["q"]
    assert (q.hit_1, q.precision_1, q.precision_5, q.recall_5, q.rr) == (1.0, 1.0, pytest.approx(2 / 3), pytest.approx(2 / 3), 1.0)
    assert q.ap == pytest.approx((1 + 2 / 3) / 3)
    assert q.ndcg_3 == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3) + 1 / 2))
    assert all(v == 0 for k, v in got["none"].asDict().items() if k != "query_id")
    docs = spark.createDataFrame([("q", "c1", "d0", 1), ("q", "c2", "d0", 2), ("q", "c3", "gold", 3)], "query_id string, chunk_id string, document_id string, rank int")
    by = metrics.per_query(metrics.by_document(docs), spark.createDataFrame([("q", "gold")], "query_id string, item_id string")).first()
    assert by.rr == 0.5


def test_quantile_takes_the_lower_place(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (10.0,), (None,)], "v double")
    assert df.agg(metrics.lower_quantile("v", 0.95)).first()[0] == 4.0
    assert metrics.ranked_quantiles(df, "v", (0.95,)).first().v == 4.0
    many = spark.range(50_000).select(F.pmod(F.xxhash64("id"), F.lit(9973)).cast("double").alias("v"), F.lit("g").alias("g"))
    want = sorted(r.v for r in many.collect())
    got = {r.p: r.v for r in metrics.ranked_quantiles(many, "v", (0.0, 0.5, 0.95, 1.0), "g").collect()}
    assert got == {p: want[int(p * (len(want) - 1))] for p in (0.0, 0.5, 0.95, 1.0)}
    assert df.where("false").agg(metrics.lower_quantile("v", 0.5)).first()[0] is None


def test_ask_answers_cites_and_guards(spark, chunks):
    got = {r.query_id: r for r in ask(chunks, ask_of(spark, "What lowers urate in gout?", "??", "zzz unheardof"), AskConfig("bm25")).collect()}
    assert "Allopurinol" in got["q0"].answer and "[1]" in got["q0"].answer and got["q0"].grounded and got["q0"].confidence > 0
    assert got["q1"].answer == OUT_OF_SCOPE and got["q1"].confidence == 0
    assert not got["q2"].grounded and got["q2"].confidence == 0
    with pytest.raises(ValueError):
        AskConfig("other")
    with pytest.raises(ValueError):
        AskConfig(top_k=0)


def test_evaluate_counts_labelled_questions_only(spark, chunks):
    q = spark.createDataFrame([("a", "urate gout", ["d1"], ["c1"]), ("b", "anything", [], []), ("c", "zzz", ["d2"], ["c2"])], "question_id string, question string, relevant_document_ids array<string>, relevant_chunk_ids array<string>")
    got = {r.granularity: r for r in evaluate(chunks, q, AskConfig("bm25", False)).collect()}
    assert got["document"].n_questions == 2 and got["document"].mrr == 0.5 and got["chunk"].hit_1 == 0.5


def test_sweep_of_sizes_retrieves_and_measures(spark, tmp_path):
    docs = [(f"d{i}", f"title {w}", [(p, "Results", f"{w} lowers pressure. " + "filler words go here. " * 25) for p in range(6)]) for i, w in enumerate(["aspirin", "warfarin", "insulin"])]
    df = spark.createDataFrame(docs, "document_id string, title string, blocks array<struct<page:int,section:string,text:string>>")
    df.selectExpr("*", "cast(null as timestamp) as ingested_at", "'' as published").write.parquet(f"{tmp_path}/source_documents.parquet")
    asked = [("q1", "What does aspirin lower?", ["d0"]), ("q2", "What does insulin lower?", ["d2", "d1"]), ("q3", "What does warfarin lower?", []), ("q4", "no such thing", None)]
    df = spark.createDataFrame(asked, "question_id string, question string, relevant_document_ids array<string>")
    df.selectExpr("*", "cast(null as timestamp) as created_at", "'' as source_title", "0d as lexical_overlap").write.parquet(f"{tmp_path}/eval_questions.parquet")
    got = {r.target: r for r in text_queries.queries()["b3_chunk_sweep"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [300, 500, 800, 1200] and got[300].n_chunks > got[1200].n_chunks
    for r in got.values():
        assert (r.n_questions, r.recall_1, r.recall_20, r.mrr) == (2, 0.75, 1.0, 1.0)
        assert 0 < r.precision_5 <= 1 and 0 < r.ndcg_5 <= 1 and r.recall_1 <= r.recall_5 <= r.recall_20
    assert got[300].overlap == 45


def test_postings_and_blocks_give_the_same_rows(spark, tmp_path):
    from trovelle.plans.pipeline import AskConfig, Index, compare, search
    from trovelle.sources import store

    r = random.Random(3)
    vocabulary = [f"word{i}" for i in range(60)]
    rows = [(f"c{i:03d}", f"d{i % 7}", "title", "part", 1, " ".join(r.choice(vocabulary[: 10 + i % 50]) for _ in range(30)), 30, 0) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, title string, section string, page int, text string, token_count int, char_start int")
    asked = spark.createDataFrame([(f"q{i}", " ".join(r.choice(vocabulary) for _ in range(5)) + " unseen") for i in range(6)] + [("none", "nothing"), (None, "word1")], "query_id string, question string")
    store.save_index(chunks, str(tmp_path / "ix"))
    tables = store.load_index(spark, str(tmp_path / "ix"))
    few = retrieve.bm25_of_tables(tables, asked, 5)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "postings" in plan and "ix/chunks" not in plan
    without = {k: v for k, v in tables.items() if k != "postings"}
    shown = lambda df: sorted((x.query_id, x["rank"], x.chunk_id, round(x.score, 8)) for x in df.collect())
    assert shown(few) == shown(retrieve.bm25_of_tables(without, asked, 5)) == shown(retrieve.bm25(chunks, asked, 5)) and len(shown(few)) == 30
    two = lambda i: sorted((x.query_id, x["rank"], x.chunk_id) for x in search(i, asked, AskConfig("hybrid", True, 10, 5)).collect())
    assert two(Index(tables)) == two(chunks)
    q = asked.where("query_id is not null").selectExpr("query_id as question_id", "question", "array('d1') as relevant_document_ids", "array('c001') as relevant_chunk_ids")
    assert {x.arm for x in compare(Index(tables), q).collect()} == {"vector", "bm25", "hybrid", "hybrid+rerank"}


def test_best_keeps_ties_by_item_over_blocks():
    import numpy as np
    import pyarrow as pa

    best = retrieve.Best(2, 3)
    best.limit = 4
    for block in range(5):
        items = pa.array([f"i{9 - block}{c}" for c in range(4)])
        best.block(0, np.array([[1.0, 1.0, 0.0, 2.0 * (block == 3)], [0.0, 0.0, 0.0, float(block)]]), items, 0.0)
    got = [(r["query_id"], r["item"], r["score"]) for b in best.rows(["x", "y"], ["query_id", "item", "score"], None) for r in b.to_pylist()]
    assert got == [("x", "i63", 2.0), ("x", "i50", 1.0), ("x", "i51", 1.0), ("y", "i53", 4.0), ("y", "i63", 3.0), ("y", "i73", 2.0)]
