"""Markers, citations, confidence, refusals, limiter, evaluation questions."""

import pytest
from pyspark.sql import functions as F

from trovelle.operators import answers as G
from trovelle.operators import evalset as E
from trovelle.operators import metrics as M


def one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "answer string")
    return [r[0] for r in df.select(expr(F.col("answer"))).collect()]


def test_markers_take_many_forms(spark):
    got = one(spark, G.normalize_markers, "a 【1†L3-L9】 b【2】", "c [1, 3] [2,4 , 5]", "d [Source 2] [ref: 3] [Citation:4]", "none", None)
    assert got == ["a [1] b[2]", "c [1][3] [2][4][5]", "d [2] [3] [4]", "none", None]


def test_citations_drop_markers_out_of_range(spark):
    hits = spark.createDataFrame([("q", f"c{i}", i, "text of passage") for i in (1, 2, 3)], "query_id string, chunk_id string, rank int, text string")
    said = spark.createDataFrame([("q", "A [2]. B [9]. C [2][1].")], "query_id string, answer string")
    assert sorted(r.marker for r in G.citations(said, hits).collect()) == [1, 2]


def test_answer_metrics(spark):
    text = "The first claim stands here [1]. The second has no mark at all. Short one."
    assert one(spark, lambda c: M.citation_accuracy(c, F.lit(3)), "x [1] [1] [9]", "nothing", None) == [pytest.approx(2 / 3), None, None]
    assert one(spark, M.citation_coverage, text, "", None) == [0.5, 0.0, 0.0]
    assert one(spark, M.is_refusal, "They do not contain information.", "It could not be found", "Fine.", None) == [True, True, False, False]


def test_confidence(spark):
    c = lambda n, s: lambda a: G.confidence(a, F.lit(n), F.lit(s))
    full = "This is a cited claim [1]. Here is another one [2]. And one more claim [3]."
    assert one(spark, c(3, 1.0), full, "x do not contain information", None) == [1.0, 0.0, 0.0]
    assert one(spark, c(0, 1.0), full) == [0.0]
    (some,) = one(spark, c(3, 0.2), full)
    assert 0 < some < 1
    assert one(spark, lambda a: G.grounded(a, F.lit(2)), "x [1]", "x [7]", "do not contain information [1]", None) == [True, False, False, False]


def test_prompts(spark):
    df = spark.createDataFrame([("What?", "[1] T | page 1"), ("What?", None), ("What?", "")], "q string, c string")
    a, b, c = (r[0] for r in df.select(G.answer_prompt(F.col("q"), F.col("c"))).collect())
    assert "[1] T" in a and "What?" in a and "do not contain information" in b and b == c


def test_json_objects(spark):
    assert one(spark, G.json_object, 'so: {"a": {"b": 1}} end', "{bad", "no", None) == ['{"a": {"b": 1}}', None, None, None]


def test_cost(spark):
    df = spark.createDataFrame([("gpt-4o", 1_000_000, 100_000), ("other", 5, 5), (None, 5, 5)], "m string, p int, c int")
    assert [r[0] for r in df.select(G.cost(F.col("m"), F.col("p"), F.col("c"))).collect()] == [3.5, 0.0, 0.0]


def test_limiter_admits_within_the_window():
    assert G.admit([(0, 400), (1, 400), (2, 400)], 1000, 10) == [0, 1, 60]
    assert G.admit([(0, 1), (0, 1), (0, 1)], 1000, 2) == [0, 0, 60]
    assert G.admit([(0, 5000)], 1000, 2) == [0]
    assert G.admit([], 1, 1) == []


def test_rolling_usage_excludes_what_is_a_window_old(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 5.0), (1, "2024-01-01 00:00:59", 2.0), (1, "2024-01-01 00:01:00", 1.0), (2, "2024-01-01 00:00:59", 9.0)], "user_id int, t string, value double").withColumn("ts", F.to_timestamp("t"))
    got = [(r.used, r.n) for r in G.rolling_usage(df, "ts", "value").orderBy("user_id", "ts").collect()]
    assert got == [(5.0, 1), (7.0, 2), (3.0, 2), (9.0, 1)]


def test_overlap(spark):
    df = spark.createDataFrame([("gout urate", "urate in gout"), ("gout migraine", "urate in gout"), ("the of", "x"), ("gout", None), (None, "gout")], "q string, p string")
    assert [r[0] for r in df.select(E.lexical_overlap(F.col("q"), F.col("p"))).collect()] == [1.0, 0.5, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    "text, good",
    [
        ("What did this study find about urate levels?", False),
        ("What does the clinical review say about gout?", False),
        ("Which of the above drugs lowers urate best?", False),
        ("Why gout?", False),
        ("Which drug lowers urate in adults with gout?", True),
        ("How is the studying of urate done in adults?", True),
        (None, False),
    ],
)
def test_self_containment(spark, text, good):
    assert one(spark, E.is_self_contained, text) == [good]


def test_slices_and_samples(spark):
    q = spark.createDataFrame([(f"q{i:02d}", o, u) for i, (o, u) in enumerate([(0.1, False), (0.5, False), (0.9, False), (None, False), (0.2, True), (0.3, True), (0.4, True)])], "question_id string, lexical_overlap double, unanswerable boolean")
    assert sorted(r[0] for r in q.select(F.explode(E.slices())).collect()) == ["all"] * 7 + ["high"] + ["low"] * 6
    got = [r.question_id for r in E.generation_sample(q, 4).orderBy("question_id").collect()]
    assert got == ["q00", "q01", "q02", "q04"]
    assert E.generation_sample(q, None).count() == 7 and E.generation_sample(q.where("not unanswerable"), 3).count() == 3
    c = spark.createDataFrame([(f"c{i}", f"d{i % 2}", 200 if i else 10, "References" if i == 1 else "Body") for i in range(8)] + [("n", "d9", None, None)], "chunk_id string, document_id string, token_count int, section string")
    got = E.sample_chunks(c, 4).collect()
    assert len(got) == 4 and len({r.document_id for r in got[:2]}) == 2 and not {r.chunk_id for r in got} & {"c0", "c1", "n"}
    assert E.sample_chunks(c, 40).count() == 6


def test_backfill_keeps_what_has_no_passage(spark):
    q = spark.createDataFrame([("a", "gout urate", ["c"], 0.1), ("b", "gout", ["gone"], 0.7), ("c", "gout", [], None)], "question_id string, question string, relevant_chunk_ids array<string>, lexical_overlap double")
    c = spark.createDataFrame([("c", "urate rises in gout", "x")], "chunk_id string, text string, question string")
    assert [(r.question_id, r.lexical_overlap) for r in E.backfill_overlap(q, c).orderBy("question_id").collect()] == [("a", 1.0), ("b", 0.7), ("c", None)]


def test_assembling_a_question_set(spark):
    made = spark.createDataFrame([(0, "c", "Which drug lowers urate in adults with gout?"), (1, "c", "What does this study say about urate?"), (2, "c", "pelomide lowers urate levels quickly"), (3, "gone", "Which drug lowers urate best?"), (4, "c", None)], "position int, chunk_id string, question string")
    c = spark.createDataFrame([("c", "d", "pelomide lowers urate levels quickly")], "chunk_id string, document_id string, text string")
    own = spark.createDataFrame([(0, "Is aspirin safe?", False), (1, "Who won the cup?", True)], "position int, question string, unanswerable boolean")
    got = {r.question_id: r for r in E.assemble(made, c, own).collect()}
    assert set(got) == {"syn_0000", "cur_0000", "cur_0001"} and got["syn_0000"].relevant_document_ids == ["d"] and got["cur_0001"].unanswerable


def test_actual_use_counts_when_it_is_more():
    from trovelle.operators.answers import admit

    assert admit([(0.0, 400.0), (1.0, 400.0), (2.0, 400.0)], 1000, 10) == [0.0, 1.0, 60.0]
    assert admit([(0.0, 400.0, 700.0), (1.0, 400.0)], 1000, 10) == [0.0, 60.0]
    assert admit([(0.0, 400.0, 100.0), (1.0, 500.0, 100.0), (2.0, 200.0)], 1000, 10) == [0.0, 1.0, 60.0]
