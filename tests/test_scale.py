"""Search over more passages than a block: what is pruned must not change a row, and texts are read once."""

import random

import numpy as np
import pyarrow as pa
import pytest

from trovelle.operators import index, retrieve
from trovelle.plans.pipeline import Index


class Shared:
    def __init__(self, value):
        self.value = value


def table(ids, dl, terms, tf):
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(dl, pa.int32()), pa.array(terms, pa.list_(pa.int64())), pa.array(tf, pa.list_(pa.int32()))], names=["chunk_id", "dl", "terms", "tf"])


@pytest.mark.parametrize("segment,lam", [(50, 1.0), (700, 1.0), (10_000, 0.5)])
def test_pruned_lexical_search_is_exact(monkeypatch, segment, lam):
    monkeypatch.setattr(retrieve, "SEGMENT", segment)
    r = np.random.default_rng(5)
    ids, idf = np.arange(40) * 7 - 90, r.uniform(0.05, 9, 40)
    docs = [np.flatnonzero(r.random(40) < np.linspace(0.6, 0.002, 40)) for _ in range(2000)]
    docs += docs[:300]  # copies, so that scores tie
    tfs = [r.integers(1, 5, len(d)) for d in docs[:2000]]
    tfs += tfs[:300]
    dl = [int(t.sum()) + i % 2000 % 9 for i, t in enumerate(tfs)]
    name = [f"c{x:05d}" for x in r.permutation(len(docs))]
    asked = [(f"q{i}", np.sort(r.choice(40, int(r.integers(1, 15)), replace=False)), 16) for i in range(30)]
    batches = [table(name[a : a + 300], dl[a : a + 300], [ids[d].tolist() for d in docs[a : a + 300]], [t.tolist() for t in tfs[a : a + 300]]) for a in range(0, len(docs), 300)]
    got: dict = {}
    for b in retrieve._lexical_block(Shared((ids, idf, asked)), 8.0, 7, 1.5, 0.75, lam)(iter(batches)):
        for row in b.to_pylist():
            got.setdefault(row["query_id"], []).extend(zip(row["items"], row["scores"]))
    for q, terms, size in asked:
        want = []
        for d, t, n, c in zip(docs, tfs, dl, name):
            hit = [(i, x) for i, x in zip(d.tolist(), t.tolist()) if i in terms]
            if hit:
                want.append((c, sum(idf[i] * x * 2.5 / (x + 1.5 * (0.25 + 0.75 * n / 8.0)) for i, x in hit) * (len(hit) / size) ** lam))
        order = lambda rows: [c for c, s in sorted(rows, key=lambda x: (-round(x[1], 9), x[0]))[:7]]
        assert order(got.get(q, [])) == order(want)


@pytest.mark.parametrize("keep_self", [True, False])
def test_pruned_vector_search_is_exact(spark, monkeypatch, keep_self):
    r = np.random.default_rng(6)
    v = r.poisson(0.4, (5000, 16)).astype(float)
    v /= np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000)), pa.array(v.tolist())], names=["id", "v"])
    monkeypatch.setattr(retrieve, "SEGMENT", 3000)
    got: dict = {}
    for b in retrieve._vector_block(Shared((list(range(150)), v[:150])), 9, keep_self, "id")(iter([batch])):
        for row in b.to_pylist():
            got.setdefault(row["query_id"], []).extend(zip(row["items"], row["scores"]))
    for q in range(150):
        s = np.einsum("ij,j->i", v, v[q])
        want = sorted((i for i in range(5000) if keep_self or i != q), key=lambda i: (-round(s[i], 9), i))[:9]
        assert [i for i, _ in sorted(got[q], key=lambda x: (-round(x[1], 9), x[0]))[:9]] == want


def test_one_pass_has_the_words_of_tokens(spark):
    r = random.Random(2)
    texts = ["", None, "The\0AK9 b", "İstanbul ÉTÉ x", "a-b the THE", *(" ".join(r.choice(["of", "Gout", "urate9", "naïve", "x"]) for _ in range(40)) for _ in range(50))]
    c = spark.createDataFrame([(f"c{i}", None, "Part" if i % 2 else None, t) for i, t in enumerate(texts)], "chunk_id string, title string, section string, text string")
    want = {}
    for row in index.tokens(c).collect():
        want[row.chunk_id] = (row.dl, sorted((index.word_id(w), row.tokens.count(w)) for w in set(row.tokens)))
    forward = index.forward(c)
    assert {row.chunk_id: (row.dl, list(zip(row.terms, row.tf))) for row in forward.collect()} == want
    held = {row.chunk_id: row.v for row in index.hashed_vectors(c, "chunk_id", index.contextual_text()).collect()}
    assert {row.chunk_id: row.v for row in index.forward_vectors(forward).collect()} == held


def test_lexical_search_makes_no_vectors_and_no_postings(spark):
    c = spark.createDataFrame([("c0", "d0", "t", "s", 1, "urate in gout")], "chunk_id string, document_id string, title string, section string, page int, text string")
    own = Index.of(c)
    asked = spark.createDataFrame([("q", "gout")], "query_id string, question string")
    assert own.lexical(asked, 3).count() == 1
    assert set(own.tables) == {"chunks", "forward", "corpus_stats"}
    assert own.dense(asked, 3).count() == 1


def test_questions_with_the_same_words_are_scored_once(spark, monkeypatch):
    seen = []
    merged = retrieve._merged
    monkeypatch.setattr(retrieve, "_merged", lambda lists, questions, *rest: seen.append(questions) or merged(lists, questions, *rest))
    chunks = spark.createDataFrame([(f"c{i}", "d", None, None, 1, f"urate gout word{i % 7}") for i in range(40)], "chunk_id string, document_id string, title string, section string, page int, text string")
    asked = spark.createDataFrame([(f"q{i}", ["Urate in gout?", "gout: the urate", "word3"][i % 3]) for i in range(60)], "query_id string, question string")
    held = Index.of(chunks)
    for ranked in (held.lexical(asked, 5), held.dense(asked, 5)):
        rows: dict = {}
        for r in ranked.collect():
            rows.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
        assert len(rows) == 60 and all(len(x) == 5 for x in rows.values())
        assert all(sorted(rows[f"q{i}"]) == sorted(rows[f"q{2 * (i % 3 == 2)}"]) for i in range(60))
    assert seen == [2, 2]


def test_long_questions_have_wider_sums():
    r = np.random.default_rng(8)
    ids, idf = np.arange(600) - 50, r.uniform(0.05, 9, 600)
    docs = [np.flatnonzero(r.random(600) < 0.3) for _ in range(900)]
    asked = [(i, np.sort(r.choice(600, 3, replace=False)), 3) for i in range(300)] + [(300, np.arange(600), 600)]
    batch = table([f"c{i:03d}" for i in range(900)], [len(d) for d in docs], [ids[d].tolist() for d in docs], [[1] * len(d) for d in docs])
    got = {row["query_id"]: row for b in retrieve._lexical_block(Shared((ids, idf, asked)), 180.0, 5, 1.5, 0.75, 1.0)(iter([batch])) for row in b.to_pylist()}
    for q, terms, size in asked[-3:]:
        have = np.zeros((900, 600), bool)
        for i, d in enumerate(docs):
            have[i, d] = True
        own = have[:, terms]
        norm = np.array([1.5 * (0.25 + 0.75 * len(d) / 180.0) for d in docs])
        s = (own * idf[terms]).sum(axis=1) * 2.5 / (1 + norm) * own.sum(axis=1) / size
        assert got[q]["items"] == [f"c{i:03d}" for i in sorted(range(900), key=lambda i: (-round(s[i], 9), i))[:5]]


def test_reranking_goes_by_words_of_the_index(spark):
    from trovelle.operators import rerank

    rows = [("c0", "d0", "Gout", None, 1, "Urate in gout, urate."), ("c1", "d0", None, "Body", 1, "The asthma"), ("c2", "d1", None, None, 1, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, title string, section string, page int, text string")
    asked = spark.createDataFrame([("q0", "What lowers urate in gout of adults?"), ("q1", "the"), ("q2", None), ("q3", "Asthma body zebra")], "query_id string, question string")
    hits = asked.select("query_id").crossJoin(chunks.select("chunk_id"))
    got = rerank.with_forward_score(hits, index.forward(chunks), asked)
    want = hits.join(chunks, "chunk_id").join(asked, "query_id").withColumn("pair_score", rerank.lexical_pair_score())
    shown = lambda df: sorted((r.query_id, r.chunk_id, r.pair_score) for r in df.select("query_id", "chunk_id", "pair_score").collect())
    assert shown(got) == shown(want) and ("q0", "c0", 0.5) in shown(got) and "text" not in got.columns


def shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.split("Initial Plan")[0].splitlines())


def ranked_lists(spark, seed, scores=True):
    r = random.Random(seed)
    rows = [(f"q{q}", f"c{c:02d}", float(s), i + 1) for q in range(12) for i, (c, s) in enumerate(zip(r.sample(range(30), 9), sorted((r.randint(0, 6) for _ in range(9)), reverse=True)))]
    return spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int")


def test_comparison_moves_rows_once_to_their_question(spark):
    from trovelle.operators import metrics

    dense, lexical = ranked_lists(spark, 1).where("query_id <> 'q3'"), ranked_lists(spark, 2).where("query_id <> 'q4'")
    both = retrieve.both_arms(dense, lexical)
    places = retrieve.places(both, 5)
    assert shuffles(both) == 1 and shuffles(places) == 1
    want = {
        "vector": dense.where("rank <= 5"),
        "bm25": lexical.where("rank <= 5"),
        "hybrid": retrieve.rrf(dense, lexical, 5),
        "hybrid_weighted": retrieve.weighted(dense, lexical, 5),
    }
    rows = places.collect()
    for arm, hits in want.items():
        assert sorted((r.query_id, r.chunk_id, r[arm]) for r in rows if r[arm] is not None) == sorted((r.query_id, r.chunk_id, r["rank"]) for r in hits.collect())
    in_documents = lambda hits: hits.selectExpr("*", "concat('d', cast(substr(chunk_id, 2) as int) % 7) as document_id")
    labels = [(f"q{i}", [f"d{i % 7}", f"d{(i + 3) % 7}", None, f"d{i % 7}"][: 1 + i % 4]) for i in range(11)] + [("q20", ["d0"]), ("q11", []), ("q12", None)]
    questions = spark.createDataFrame(labels, "question_id string, relevant_document_ids array<string>")
    got = metrics.per_query_of_arms(in_documents(places), questions, tuple(want), (1, 3, 5))
    for arm, hits in want.items():
        one = metrics.per_query(metrics.by_document(in_documents(hits)), metrics.qrels(questions), (1, 3, 5))
        named = lambda df: sorted((r.query_id, *(round(r[c], 12) for c in one.columns[1:])) for r in df.collect())
        assert named(got.where(f"arm = '{arm}'")) == named(one)


def test_overlap_moves_rows_once_to_their_question(spark):
    a, b = ranked_lists(spark, 3).where("query_id <> 'q3'"), ranked_lists(spark, 4).where("query_id <> 'q4'")
    got = retrieve.arm_overlap(a, b)
    assert shuffles(got) == 1
    of = lambda df, q: {r.chunk_id for r in df.where(f"query_id = '{q}'").collect()}
    for r in got.collect():
        x, y = of(a, r.query_id), of(b, r.query_id)
        assert (r.first_only, r.shared, r.second_only, r.jaccard) == (len(x - y), len(x & y), len(y - x), round(len(x & y) / len(x | y), 3))


def test_queries_of_counts_are_scored_by_sums(spark):
    r = np.random.default_rng(9)
    v = r.poisson(0.3, (3000, 64)).astype(float)
    v[2500:] = v[:500]  # copies, so that scores tie
    v /= np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
    q = np.zeros((90, 64))
    for i in range(80):
        q[i, r.choice(64, 1 + i % 9, replace=False)] += 1 + (np.arange(1 + i % 9) == 0) * (i % 3)
    q[80:89] = r.random((9, 64))  # no counts; the last has no words
    q /= np.where((n := np.linalg.norm(q, axis=1, keepdims=True)) > 0, n, 1)
    counted = retrieve._Counted(q)
    assert counted.others.tolist() == list(range(80, 90))
    name = [f"c{x:04d}" for x in r.permutation(3000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(name[a : a + 700]), pa.array(v[a : a + 700].tolist())], names=["id", "v"]) for a in range(0, 3000, 700)]
    for most in (400, 1000, 5000):
        got: dict = {}
        for b in retrieve._vector_block(Shared((list(range(90)), q)), 9, True, "id", most)(iter(batches)):
            for row in b.to_pylist():
                got.setdefault(row["query_id"], []).extend(zip(row["items"], row["scores"]))
        for i in range(90):
            s = v @ q[i]
            order = lambda rows: [c for c, x in sorted(rows, key=lambda x: (-round(x[1], 9), x[0]))[:9]]
            assert order(got[i]) == order(zip(name, s))


def test_segments_of_a_task_are_alike(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "SEGMENT", 1000)
    items = spark.range(1)
    tasks = spark.sparkContext.defaultParallelism
    for own in (10, 1000, 1130, 2300, 9000):
        size = retrieve._segment_of(items, own * tasks)
        rows = own * tasks / retrieve._tasks(spark, own * tasks)
        assert size >= 1000 and (rows > 1250 or size >= rows) and size <= 1600


def test_segments_hold_only_the_asked_words():
    r = np.random.default_rng(10)
    docs = [np.flatnonzero(r.random(50) < 0.4) for _ in range(1000)]
    tfs = [r.integers(1, 400, len(d)) for d in docs]
    batches = [table([f"c{i}" for i in range(a, a + 130)], [7] * len(docs[a : a + 130]), [d.tolist() for d in docs[a : a + 130]], [t.tolist() for t in tfs[a : a + 130]]) for a in range(0, 910, 130)]
    ids = np.array([3, 8, 41, 77])
    seen = list(retrieve._known(iter(batches), ids, lambda dl: dl * 2, 260))
    assert [len(items) for items, *_ in seen] == [260, 260, 260, 130]
    at = 0
    for items, norm, row, owner, tf in seen:
        want = [(i, int(w), int(t)) for i in range(len(items)) for w, t in zip(docs[at + i], tfs[at + i]) if w in (3, 8, 41)]
        assert list(zip(owner.tolist(), ids[row].tolist(), tf.tolist())) == want and (norm == 14).all()
        assert items.to_pylist() == [f"c{at + i}" for i in range(len(items))]
        at += len(items)


@pytest.mark.parametrize("name", ["b4_best_arms", "b5_slice_pivot"])
def test_lists_of_the_arms_are_moved_together(spark, name):
    import __spark_entry__

    assert shuffles(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")) <= 8


def test_lists_pass_as_bytes():
    import pyarrow as pa

    names = ["", "c\0d", "ä", *(f"c{i}" for i in range(300))]
    items = pa.StructArray.from_arrays([pa.array(names), pa.array([(-1) ** i * (1 << 62) - i for i in range(303)], pa.int64())], names=["chunk_id", "document"])
    r = np.random.default_rng(2)
    rows = [(q, np.sort(r.choice(303, n, replace=False)), r.normal(size=n)) for q, n in enumerate([5, 1, 0, 40, 300])]
    lists = pa.Table.from_batches([*retrieve._given(list(range(5)), None, rows[:3], items), *retrieve._given(list(range(5)), None, rows[3:], items)])
    for part in (lists, lists.slice(1, 3), lists.slice(0, 0)):
        n, own, documents, scores = retrieve.unpacked(part)
        some = [rows[q] for q in part["query_id"].to_pylist()]
        assert n.tolist() == [len(x[1]) for x in some]
        assert own.to_pylist() == [names[i] for x in some for i in x[1]] and scores.tolist() == [s for x in some for s in x[2]]
        assert documents.tolist() == [items[int(i)].as_py()["document"] for x in some for i in x[1]]


@pytest.mark.parametrize("lam", [1.0, 0.5])
def test_questions_with_the_same_frequent_words_are_scored_together(monkeypatch, lam):
    r = np.random.default_rng(5)
    ids, often = np.arange(400), 12
    docs = [np.flatnonzero(r.random(400) < np.where(ids < often, 0.3, 0.004)) for _ in range(3000)]
    tfs = [r.integers(1, 4, len(d)) for d in docs]
    df = np.bincount(np.concatenate(docs), minlength=400)
    idf = np.log(1 + (3000 - df + 0.5) / (df + 0.5))
    sets = [np.sort(r.choice(often, 3, replace=False)) for _ in range(6)]
    asked = []
    for q in range(240):
        terms = np.concatenate([sets[q % 6], np.sort(often + r.choice(400 - often, q % 4, replace=False))])
        asked.append((q, terms, len(terms) + q % 3))
    batches = [table([f"c{i:04d}" for i in range(a, a + 1500)], [100 + i % 90 for i in range(1500)], [docs[i].tolist() for i in range(a, a + 1500)], [tfs[i].tolist() for i in range(a, a + 1500)]) for a in (0, 1500)]
    alone = []
    best = retrieve._Words.best
    monkeypatch.setattr(retrieve._Words, "best", lambda self, *rest: alone.append(1) or best(self, *rest))
    rows = [x for b in retrieve._lexical_block(Shared((ids, idf, asked)), 140.0, 7, 1.5, 0.75, lam, 1500)(iter(batches)) for x in b.to_pylist()]
    assert len(alone) == 2 * len({s.tobytes() for s in sets})  # once a segment and set of frequent words, not once a question
    got: dict = {}
    for x in rows:
        got.setdefault(x["query_id"], []).extend(zip(x["scores"], x["items"]))
    counts, norm = np.zeros((3000, 400)), np.array([1.5 * (0.25 + 0.75 * (100 + i % 1500 % 90) / 140.0) for i in range(3000)])
    for i in range(3000):
        counts[i, docs[i]] = tfs[i]
    for q, terms, size in asked:
        tf = counts[:, terms]
        s = np.round((idf[terms] * tf * 2.5 / (tf + norm[:, None])).sum(axis=1) * ((tf > 0).sum(axis=1) / size) ** lam, 9)
        want = sorted(((-x, f"c{i:04d}") for i, x in enumerate(s.tolist()) if x > 0))[:7]
        assert [c for _, c in sorted((-round(x, 9), c) for x, c in got[q])[:7]] == [c for _, c in want]


@pytest.mark.parametrize("name", ["b4_best_arms", "b5_slice_pivot"])
def test_comparison_of_arms_moves_lists_once_and_writes_no_texts(spark, name, monkeypatch, tmp_path):
    import __spark_entry__

    from trovelle.plans import search_queries

    monkeypatch.setattr(search_queries, "_INDEXES", {})
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert shuffles(df) <= 5
    assert all("chunks" not in held.tables for held in search_queries._INDEXES.values())


def test_what_lists_of_a_question_reach_together():
    from trovelle.operators import compare

    r = np.random.default_rng(4)
    for _ in range(60):
        of = np.sort(r.integers(0, 5, 12))
        n = r.integers(0, 9, 12)
        s = np.concatenate([np.sort(r.integers(0, 6, x) / 7)[::-1] for x in n] or [np.zeros(0)])
        own = np.repeat(of, n)
        for q, bound in zip(of.tolist(), compare._reached(of, n, s, 5, 8).tolist()):
            best = np.sort(s[own == q])[::-1][:8]
            assert (len(best) < 8 and bound == -np.inf) or bound <= best[-1]
