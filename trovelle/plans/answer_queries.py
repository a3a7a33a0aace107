"""Queries of answering, evaluation questions, answer metrics and service figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovelle.functions import text as T
from trovelle.operators import answers as G
from trovelle.operators import corpus, evalset, metrics
from trovelle.plans import sqlparts as S
from trovelle.plans.search_queries import RERANK, bm25_sql, chunks, questions, read, reranked, with_texts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return wrap


def logged(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.latest_answers(read(spark, sf, "answers"))


_BM = bm25_sql(20)
_TR = S.truncate("coalesce(text, '')", 700)


@add("g1_contexts", f"{_BM}, {RERANK} SELECT query_id, md5(string_agg('[' || rank || '] ' || coalesce(title, '') || ' | page ' || coalesce(page::VARCHAR, '') || ' | section: ' || coalesce(section, '') || chr(10) || ({_TR}), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest FROM rr GROUP BY 1")
def g1(spark, sf):
    return G.contexts(with_texts(spark, sf, reranked(spark, sf))).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"))


@add("g2_prompts")
def g2(spark, sf):
    held = G.contexts(with_texts(spark, sf, reranked(spark, sf)))
    q = questions(spark, sf).select(F.col("question_id").alias("query_id"), "question").join(held, "query_id", "left")
    return q.select("query_id", G.answer_prompt(F.col("question"), F.col("context")).alias("prompt"))


_FLAT = S.collapse("coalesce(title, '') || ' | page ' || coalesce(page::VARCHAR, '') || ' | section: ' || coalesce(section, '') || ' ' || coalesce(text, '')")


@add("g4_extractive", f"{_BM}, {RERANK}, ex AS (SELECT query_id, rank, {S.sentences('flat')} AS s FROM (SELECT query_id, rank, {_FLAT} AS flat FROM rr WHERE rank <= 3)) SELECT query_id, string_agg(array_to_string(s[1:2], ' ') || ' [' || rank || ']', ' ' ORDER BY rank) AS answer FROM ex GROUP BY 1")
def g4(spark, sf):
    return G.extractive(with_texts(spark, sf, reranked(spark, sf).where(F.col("rank") <= 3)))  # it reads no others


@add("g7_rolling_usage", """SELECT event_id, round(sum(value) OVER w, 4) AS used, count(*) OVER w AS n FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""")
def g7(spark, sf):
    return G.rolling_usage(read(spark, sf, "events"), "ts", "value").select("event_id", F.round("used", 4).alias("used"), "n")


@add("g8_cost", f"WITH {S.ANSWERS}, p AS (SELECT * FROM (VALUES ('model-a', 0.15::DOUBLE, 0.60::DOUBLE), ('model-b', 2.5::DOUBLE, 10.0::DOUBLE)) v(model, pp, pc)) SELECT answer_id, round(coalesce((usage.prompt_tokens * pp + usage.completion_tokens * pc) / 1e6, 0), 8) AS cost FROM a LEFT JOIN p USING (model)")
def g8(spark, sf):
    prices = spark.createDataFrame([("model-a", 0.15, 0.60), ("model-b", 2.5, 10.0)], "model string, pp double, pc double")
    a = logged(spark, sf).join(F.broadcast(prices), "model", "left")
    return a.select("answer_id", F.round(F.coalesce((F.col("usage.prompt_tokens") * F.col("pp") + F.col("usage.completion_tokens") * F.col("pc")) / 1e6, F.lit(0.0)), 8).alias("cost"))


_VARIANT = "replace(replace(coalesce(answer, ''), '[2]', '【2†L1-L9】'), '[3]', '[Source 3, ]') || ' [1, 4,5] [ref: 2]'"
_M1 = S.re_sub(_VARIANT, r"【\s*([0-9]{1,2})\s*(?:†[^】]*)?】", "'[\\1]'")
_M2 = S.re_sub(_M1, r"(?i)\[\s*(?:source|ref|citation)\s*[: ]\s*([0-9]{1,2})\s*\]", "'[\\1]'")
_M3 = _M2
for _ in range(6):
    _M3 = S.re_sub(_M3, r"\[\s*([0-9]{1,2})\s*,\s*([0-9]{1,2}(?:\s*,\s*[0-9]{1,2})*)\s*\]", "'[\\1][\\2]'")


@add("g9_markers", f"WITH {S.ANSWERS} SELECT answer_id, {_M3} AS normal FROM a")
def g9(spark, sf):
    text = F.concat(F.replace(F.replace(F.coalesce("answer", F.lit("")), F.lit("[2]"), F.lit("【2†L1-L9】")), F.lit("[3]"), F.lit("[Source 3, ]")), F.lit(" [1, 4,5] [ref: 2]"))
    return logged(spark, sf).select("answer_id", G.normalize_markers(text).alias("normal"))


@add("g10_citations", f"WITH {S.ANSWERS}, {S.CHUNKS}, m AS (SELECT answer_id, unnest(list_distinct({S.MARKERS})) AS marker, contexts FROM a) SELECT answer_id, marker, contexts[marker].chunk_id AS chunk_id, {S.snippet('c.text', 400)} AS snippet FROM m LEFT JOIN c ON c.chunk_id = contexts[marker].chunk_id WHERE marker BETWEEN 1 AND len(contexts)")
def g10(spark, sf):
    m = logged(spark, sf).select("answer_id", "contexts", F.explode(F.array_distinct(metrics.markers(F.col("answer")))).alias("marker"))
    own = m.where("marker between 1 and size(contexts)").select("answer_id", "marker", F.expr("contexts[marker - 1].chunk_id").alias("chunk_id"))
    c = chunks(spark, sf).select("chunk_id", T.snippet(F.col("text"), 400).alias("snippet"))
    return own.join(c, "chunk_id", "left").select("answer_id", "marker", "chunk_id", "snippet")


_N = "coalesce(len(contexts), 0)"
_TOP = "coalesce(contexts[1].score, 0.0)"
_VALID = f"len(list_filter(list_distinct({S.MARKERS}), lambda x: x BETWEEN 1 AND {_N}))"


@add("g12_confidence", f"""WITH {S.ANSWERS} SELECT answer_id, CASE WHEN answer IS NULL OR contains(lower(answer), 'do not contain information') OR {_N} <= 0 THEN 0.0
ELSE round(greatest(0.0, least(1.0, 0.5 * greatest(0.0, least(1.0, {_TOP})) + 0.35 * {S.COVERAGE} + 0.15 * least({_VALID} / 3.0::DOUBLE, 1.0))), 3) END AS confidence,
coalesce(NOT contains(lower(answer), 'do not contain information') AND {_VALID} > 0, false) AS grounded FROM a""")
def g12(spark, sf):
    n = F.coalesce(F.size("contexts"), F.lit(0))
    top = F.coalesce(F.try_element_at(F.col("contexts"), F.lit(1))["score"], F.lit(0.0))
    return logged(spark, sf).select("answer_id", G.confidence(F.col("answer"), n, top).alias("confidence"), G.grounded(F.col("answer"), n).alias("grounded"))


@add("g15_json_objects", "SELECT record_id, CASE WHEN regexp_extract(payload, '(?s)\\{.*\\}') <> '' THEN json_valid(regexp_extract(payload, '(?s)\\{.*\\}')) ELSE false END AS valid FROM raw_documents")
def g15(spark, sf):
    return read(spark, sf, "raw_documents").select("record_id", G.json_object(F.col("payload")).isNotNull().alias("valid"))


@add("m9_citation_accuracy", f"WITH {S.ANSWERS} SELECT answer_id, round(CASE WHEN len({S.MARKERS}) > 0 THEN len(list_filter({S.MARKERS}, lambda x: x BETWEEN 1 AND {_N}))::DOUBLE / len({S.MARKERS}) END, 6) AS accuracy, round({S.COVERAGE}, 6) AS coverage FROM a")
def m9(spark, sf):
    n = F.coalesce(F.size("contexts"), F.lit(0))
    return logged(spark, sf).select("answer_id", F.round(metrics.citation_accuracy(F.col("answer"), n), 6).alias("accuracy"), F.round(metrics.citation_coverage(F.col("answer")), 6).alias("coverage"))


_REF = f"regexp_matches(lower(coalesce(answer, '')), '{'|'.join(metrics.REFUSAL_PHRASES)}')"


@add("m12_refusal_rates", f"""WITH {S.ANSWERS}, {S.QUESTIONS} SELECT strategy, count(*) AS n, round(avg(CASE WHEN {_REF} THEN 1.0 ELSE 0.0 END), 6) AS refusal_rate,
round(avg(CASE WHEN NOT unanswerable THEN CASE WHEN {_REF} THEN 1.0 ELSE 0.0 END END), 6) AS false_refusal_rate,
round(avg(CASE WHEN unanswerable THEN CASE WHEN {_REF} THEN 1.0 ELSE 0.0 END END), 6) AS correct_refusal_rate FROM a LEFT JOIN (SELECT question_id, unanswerable FROM q) USING (question_id) GROUP BY 1""")
def m12(spark, sf):
    q = questions(spark, sf).select("question_id", "unanswerable")
    a = logged(spark, sf).join(q, "question_id", "left").withColumn("r", metrics.is_refusal(F.col("answer")).cast("double"))
    return a.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("r"), 6).alias("refusal_rate"),
        F.round(F.avg(F.when(~F.col("unanswerable"), F.col("r"))), 6).alias("false_refusal_rate"),
        F.round(F.avg(F.when(F.col("unanswerable"), F.col("r"))), 6).alias("correct_refusal_rate"),
    )


@add("m13_lexical_judge", f"""WITH {S.ANSWERS}, {S.CHUNKS}, k AS (SELECT answer_id, question, answer, (SELECT string_agg(c.text, ' ') FROM c WHERE list_contains(list_transform(contexts, lambda x: x.chunk_id), c.chunk_id)) AS ctx FROM a)
SELECT answer_id, round(CASE WHEN len(list_distinct({S.tokens('answer')})) > 0 THEN len(list_intersect(list_distinct({S.tokens('answer')}), list_distinct({S.tokens('ctx')})))::DOUBLE / len(list_distinct({S.tokens('answer')})) END, 6) AS support,
round(CASE WHEN len(list_distinct({S.tokens('question')})) > 0 THEN len(list_intersect(list_distinct({S.tokens('question')}), list_distinct({S.tokens('answer')})))::DOUBLE / len(list_distinct({S.tokens('question')})) END, 6) AS relevance FROM k""")
def m13(spark, sf):
    """The offline judge: the share of an answer's words that its contexts have, and of the question's that the answer has."""
    return judged(spark, sf).select("answer_id", "support", "relevance")


@add("m13_three_metrics")
def m13_all(spark, sf):
    """The offline judge whole: context_relevance is the share of the question's words that the contexts have."""
    return judged(spark, sf)


def judged(spark, sf):
    a = logged(spark, sf).select("answer_id", "question", "answer", "contexts")
    ids = a.select("answer_id", F.explode("contexts.chunk_id").alias("chunk_id")).distinct()
    ctx = ids.join(chunks(spark, sf).select("chunk_id", T.tokenize(F.col("text")).alias("t")), "chunk_id").groupBy("answer_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("ctx"))
    x = a.join(ctx, "answer_id", "left").select("answer_id", F.array_distinct(T.tokenize(F.col("answer"))).alias("w"), F.array_distinct(T.tokenize(F.col("question"))).alias("q"), F.coalesce("ctx", F.array().cast("array<string>")).alias("ctx"))
    share = lambda p, o: F.round(F.when(F.size(p) > 0, F.size(F.array_intersect(p, o)) / F.size(p)), 6)
    return x.select("answer_id", share("w", "ctx").alias("support"), share("q", "w").alias("relevance"), share("q", "ctx").alias("context_relevance"))


@add("m14_latency", f"""WITH {S.ANSWERS}, x AS (SELECT strategy, timings.total_latency AS t, row_number() OVER (PARTITION BY strategy ORDER BY timings.total_latency) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM a WHERE timings.total_latency IS NOT NULL)
SELECT strategy, round(avg(t), 6) AS mean, max(CASE WHEN i = floor(0.5 * (n - 1)) THEN t END) AS p50, max(CASE WHEN i = floor(0.95 * (n - 1)) THEN t END) AS p95, max(CASE WHEN i = floor(0.99 * (n - 1)) THEN t END) AS p99 FROM x GROUP BY 1""")
def m14(spark, sf):
    a = logged(spark, sf).select("strategy", F.col("timings.total_latency").alias("t"))
    q = metrics.ranked_quantiles(a, "t", (0.5, 0.95, 0.99), "strategy").groupBy("strategy").agg(*(F.max(F.when(F.col("p") == p, F.col("t"))).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)))
    return a.groupBy("strategy").agg(F.round(F.avg("t"), 6).alias("mean")).join(q, "strategy")


@add("m15_means", f"WITH {S.ANSWERS} SELECT model, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(usage.total_tokens), 6) AS tokens, round(avg(len(citations)), 6) AS citations FROM a GROUP BY 1")
def m15(spark, sf):
    n = F.size("citations")
    return logged(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("usage.total_tokens"), 6).alias("tokens"), F.round(F.avg(n), 6).alias("citations"))


@add("m16_service_window", f"""WITH {S.ANSWERS}, l AS (SELECT timings.total_latency AS t FROM a ORDER BY logged_at DESC NULLS LAST, answer_id DESC LIMIT 500), x AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM l)
SELECT max(n) AS n, max(CASE WHEN i = floor(0.5 * (n - 1)) THEN t END) AS p50, max(CASE WHEN i = floor(0.95 * (n - 1)) THEN t END) AS p95, max(CASE WHEN i = floor(0.99 * (n - 1)) THEN t END) AS p99 FROM x""")
def m16(spark, sf):
    """Quantiles over the last 500 requests: a window of fixed length, which is the feature."""
    last = logged(spark, sf).orderBy(F.col("logged_at").desc_nulls_last(), F.desc("answer_id")).limit(500).select(F.col("timings.total_latency").alias("t"))
    return last.agg(F.count(F.lit(1)).alias("n"), *(metrics.lower_quantile("t", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)))


@add("e1_lexical_overlap", f"""WITH {S.QUESTIONS}, {S.CHUNKS} SELECT question_id, chunk_id, round(CASE WHEN len(x) > 0 THEN len(list_intersect(x, y))::DOUBLE / len(x) ELSE 0 END, 6) AS overlap FROM (
SELECT question_id, c.chunk_id, list_distinct({S.tokens('question')}) AS x, list_distinct({S.tokens('c.text')}) AS y FROM (SELECT DISTINCT question_id, question, unnest(relevant_chunk_ids) AS chunk_id FROM q) g JOIN c ON c.chunk_id = g.chunk_id)""")
def e1(spark, sf):
    g = questions(spark, sf).select("question_id", "question", F.explode(F.array_distinct("relevant_chunk_ids")).alias("chunk_id"))
    c = chunks(spark, sf).select("chunk_id", "text")
    return g.join(c, "chunk_id").select("question_id", "chunk_id", F.round(evalset.lexical_overlap(F.col("question"), F.col("text")), 6).alias("overlap"))


@add("e2_self_contained", f"WITH {S.QUESTIONS} SELECT question_id, len({S.words('question')}) >= 4 AND NOT regexp_matches(question, {S.lit(evalset.ANAPHORIC)}) AND NOT regexp_matches(question, {S.lit(evalset.POINTING)}) AS self_contained FROM q")
def e2(spark, sf):
    return questions(spark, sf).select("question_id", evalset.is_self_contained(F.col("question")).alias("self_contained"))


@add("e3_sample_chunks", f"""WITH {S.CHUNKS}, g AS (SELECT chunk_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY sha1('13:' || chunk_id), chunk_id) AS turn FROM c
WHERE token_count >= 180 AND NOT coalesce(regexp_matches(lower(section), '^(?:reference|abbreviation)'), false))
SELECT chunk_id, document_id, turn::INT AS turn FROM g ORDER BY turn, sha1('13:' || document_id), document_id LIMIT 40""")
def e3(spark, sf):
    return evalset.sample_chunks(chunks(spark, sf), 40)


@add("e4_filtered_questions", f"WITH {S.QUESTIONS} SELECT question_id, 'syn' AS origin FROM q WHERE NOT unanswerable AND coalesce(lexical_overlap, 0) <= 0.75 AND len({S.words('question')}) >= 4 AND NOT regexp_matches(question, {S.lit(evalset.ANAPHORIC)}) AND NOT regexp_matches(question, {S.lit(evalset.POINTING)}) UNION ALL SELECT question_id, 'cur' FROM q WHERE unanswerable")
def e4(spark, sf):
    q = questions(spark, sf)
    made = q.where(~F.col("unanswerable") & (F.coalesce("lexical_overlap", F.lit(0.0)) <= 0.75) & evalset.is_self_contained(F.col("question"))).select("question_id", F.lit("syn").alias("origin"))
    return made.unionByName(q.where("unanswerable").select("question_id", F.lit("cur").alias("origin")))


@add("e6_backfill", f"""WITH {S.QUESTIONS}, {S.CHUNKS} SELECT question_id, round(CASE WHEN c.text IS NOT NULL THEN (CASE WHEN len({S.tokens('question')}) > 0 THEN len(list_intersect(list_distinct({S.tokens('question')}), list_distinct({S.tokens('c.text')})))::DOUBLE / len(list_distinct({S.tokens('question')})) ELSE 0 END) ELSE lexical_overlap END, 6) AS lexical_overlap
FROM q LEFT JOIN c ON c.chunk_id = q.relevant_chunk_ids[1]""")
def e6(spark, sf):
    return evalset.backfill_overlap(questions(spark, sf), chunks(spark, sf)).select("question_id", F.round("lexical_overlap", 6).alias("lexical_overlap"))


@add("e7_slices", f"WITH {S.QUESTIONS} SELECT slice, count(*) AS n FROM (SELECT unnest(['all', CASE WHEN coalesce(lexical_overlap, 0) <= 0.5 THEN 'low' ELSE 'high' END]) AS slice FROM q WHERE len(relevant_document_ids) > 0) GROUP BY 1")
def e7(spark, sf):
    q = questions(spark, sf).where(F.size("relevant_document_ids") > 0)
    return q.select(F.explode(evalset.slices()).alias("slice")).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@add("e8_generation_sample", f"""WITH {S.QUESTIONS}, r AS (SELECT question_id, coalesce(unanswerable, false) AS u, row_number() OVER (PARTITION BY coalesce(unanswerable, false) ORDER BY question_id) AS rn FROM q), p AS (SELECT least(count(*), 6) AS np FROM r WHERE u)
SELECT question_id, u AS unanswerable FROM r, p WHERE CASE WHEN u THEN rn <= 6 ELSE rn <= 25 - np END""")
def e8(spark, sf):
    return evalset.generation_sample(questions(spark, sf), 25).select("question_id", F.coalesce("unanswerable", F.lit(False)).alias("unanswerable"))


@add("e9_most_leaky", f"WITH {S.QUESTIONS} SELECT question_id, lexical_overlap FROM q WHERE lexical_overlap IS NOT NULL ORDER BY lexical_overlap DESC, question_id LIMIT 5")
def e9(spark, sf):
    return questions(spark, sf).where("lexical_overlap is not null").orderBy(F.desc("lexical_overlap"), "question_id").limit(5).select("question_id", "lexical_overlap")


@add("v1_event_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def v1(spark, sf):
    """The rolling service figures as tumbling windows; the streaming form is trovelle.streaming.rolling."""
    from trovelle.streaming.rolling import hourly

    return hourly(read(spark, sf, "events"))


@add("g3_question_prompts", f"WITH {S.CHUNKS} SELECT chunk_id, md5('Document: ' || title || chr(10) || 'Section: ' || section || chr(10) || chr(10) || 'Excerpt:' || chr(10) || ({S.truncate('text', 600)})) AS digest FROM c")
def g3(spark, sf):
    from trovelle.operators.models import question_prompt

    return chunks(spark, sf).select("chunk_id", F.md5(question_prompt(F.col("title"), F.col("section"), F.col("text")).cast("binary")).alias("digest"))


@add("g14_ask")
def g14(spark, sf):
    """Questions to cited answers in one plan, with the extractive answerer."""
    from trovelle.plans.pipeline import AskConfig, ask
    from trovelle.plans.search_queries import asked, index_of

    return ask(index_of(spark, sf), asked(spark, sf), AskConfig("bm25"))


@add("b1_evaluate")
def b1(spark, sf):
    from trovelle.plans.pipeline import AskConfig, evaluate
    from trovelle.plans.search_queries import index_of

    return evaluate(index_of(spark, sf), questions(spark, sf), AskConfig("hybrid", True))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
