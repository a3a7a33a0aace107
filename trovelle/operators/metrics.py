"""Metrics of ranked lists and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 20)


def qrels(questions: DataFrame, granularity: str = "document") -> DataFrame:
    """(query_id, item_id), each once; questions without labels have none."""
    labels = {"document": "relevant_document_ids", "chunk": "relevant_chunk_ids"}[granularity]
    return questions.select(F.col("question_id").alias("query_id"), F.explode(F.array_distinct(labels)).alias("item_id")).where("item_id is not null")


def by_document(hits: DataFrame) -> DataFrame:
    """Each document once a question, at its best place, ranked anew."""
    best = hits.groupBy("query_id", "document_id").agg(F.min("rank").alias("best"))
    w = Window.partitionBy("query_id").orderBy("best")
    return best.select("query_id", F.col("document_id").alias("item_id"), F.row_number().over(w).alias("rank"))


def per_query(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Metrics of each labelled question over ranked (query_id, item_id, rank); a question without hits scores 0.

    Precision divides by what was retrieved up to k, average precision by the lesser of the relevant and the retrieved.
    """
    totals = relevant.groupBy("query_id").agg(F.countDistinct("item_id").alias("n_relevant"))
    marked = ranked.join(relevant.withColumn("rel", F.lit(1)), ["query_id", "item_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.join(totals.select("query_id"), "query_id", "left_semi").withColumn("hits_so_far", F.sum("rel").over(w))
    aggs = [
        F.max("rank").alias("n_retrieved"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_hit"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits_so_far") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
    ]
    for k in ks:
        top = F.col("rank") <= k
        aggs += [
            F.sum(F.when(top, F.col("rel")).otherwise(0)).alias(f"h{k}"),
            F.sum(F.when(top, 1).otherwise(0)).alias(f"t{k}"),
            F.sum(F.when(top & (F.col("rel") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"d{k}"),
        ]
    one = totals.join(marked.groupBy("query_id").agg(*aggs), "query_id", "left")
    return one.select("query_id", *_values(ks))


def _ideal(k: int) -> Column:
    terms = [F.when(F.col("n_relevant") > i, F.lit(1.0) / F.log2(F.lit(float(i + 2)))).otherwise(0.0) for i in range(k)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _values(ks: tuple[int, ...]) -> list[Column]:
    """The metrics from n_relevant, n_retrieved, first_hit, ap_sum, and of each k the hits (h), the retrieved (t) and the gain (d) up to it."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    cols = []
    for k in ks:
        cols += [
            z(F.when(F.col(f"h{k}") > 0, 1.0)).alias(f"hit_{k}"),
            z(F.when(F.col(f"t{k}") > 0, F.col(f"h{k}") / F.col(f"t{k}"))).alias(f"precision_{k}"),
            z(F.col(f"h{k}") / F.col("n_relevant")).alias(f"recall_{k}"),
            z(F.col(f"d{k}") / _ideal(k)).alias(f"ndcg_{k}"),
        ]
    return [*cols, z(1 / F.col("first_hit")).alias("rr"), z(F.col("ap_sum") / F.least("n_relevant", "n_retrieved")).alias("ap")]


def per_query_of_arms(places: DataFrame, questions: DataFrame, arms: tuple[str, ...], ks: tuple[int, ...] = KS) -> DataFrame:
    """per_query() by document for several arms at once: (arm, query_id, metrics) from passages (query_id, document_id, and by arm the rank, null where it has not got the passage).

    Rows move once, to their question; of the documents of an arm, ranked by their best passage, only the places of relevant ones go on.
    """
    own = lambda a: F.col(f"`{a}`")
    labels = F.array_distinct(F.array_compact("relevant_document_ids"))
    wanted = questions.where(F.size(labels) > 0).select(F.col("question_id").alias("query_id"), labels.alias("labels__"))
    best = places.repartition("query_id").groupBy("query_id", "document_id").agg(*(F.min(own(a)).alias(a) for a in arms))
    for a in arms:
        best = best.withColumn(a, F.when(own(a).isNotNull(), F.row_number().over(Window.partitionBy("query_id").orderBy(own(a).asc_nulls_last()))))
    found = best.join(wanted, "query_id").withColumn("rel__", F.coalesce(F.array_contains("labels__", F.col("document_id")), F.lit(False)))
    of = [F.struct(F.max(own(a)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("rel__"), own(a)))).alias("at")).alias(a) for a in arms]
    rows = wanted.select("query_id", F.size("labels__").alias("n_relevant")).join(found.groupBy("query_id").agg(*of), "query_id", "left")
    rows = rows.select("query_id", "n_relevant", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), own(a)["n"].alias("n"), own(a)["at"].alias("at")) for a in arms))).alias("x"))
    rows = rows.select("query_id", "n_relevant", "x.arm", F.col("x.n").alias("n_retrieved"), F.coalesce("x.at", F.array().cast("array<int>")).alias("at"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    upto = lambda k: F.filter("at", lambda r: r <= k)
    cols = [F.get("at", F.lit(0)).alias("first_hit"), total(F.transform("at", lambda r, i: (i + 1) / r)).alias("ap_sum")]
    for k in ks:
        cols += [F.size(upto(k)).alias(f"h{k}"), F.least(F.col("n_retrieved"), F.lit(k)).alias(f"t{k}"), total(F.transform(upto(k), lambda r: 1 / F.log2(r + 1))).alias(f"d{k}")]
    return rows.select("arm", "query_id", "n_relevant", "n_retrieved", *cols).select("arm", "query_id", *_values(ks))


def summary(per: DataFrame, *by: str) -> DataFrame:
    """Means over questions, to six places."""
    values = [c for c in per.columns if c not in ("query_id", *by)]
    names = {"rr": "mrr", "ap": "map"}
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_questions"), *(F.round(F.avg(c), 6).alias(names.get(c, c)) for c in values))


def markers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([0-9]{1,2})\]"), F.lit(1)), lambda m: m.cast("int"))


def citation_accuracy(text: Column, n_contexts: Column) -> Column:
    """Share of markers (repeats count) that point at a context; null without markers."""
    m = markers(text)
    return F.when(F.size(m) > 0, F.size(F.filter(m, lambda x: x.between(1, n_contexts))) / F.size(m))


def citation_coverage(text: Column) -> Column:
    """Share of statements of four words or more that carry a marker; 0 without such."""
    from trovelle.functions.text import statements

    s = statements(text)
    return F.when(F.size(s) > 0, F.size(F.filter(s, lambda x: x.rlike(r"\[[0-9]{1,2}\]"))) / F.size(s)).otherwise(F.lit(0.0))


# Phrases that make an answer a refusal.
REFUSAL_PHRASES = ["do not contain information", "does not contain information", "could not be found", "no information", "not contain"]


def is_refusal(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(REFUSAL_PHRASES))


def lower_quantile(values: str, p: float) -> Column:
    """The value at place floor(p * (n - 1)) of the sorted values, exactly."""
    v = F.sort_array(F.collect_list(values))
    return F.get(v, F.floor(p * (F.size(v) - 1)).cast("int"))


def ranked_quantiles(df: DataFrame, value: str, ps: tuple[float, ...], *by: str, accuracy: int = 10_000) -> DataFrame:
    """(by, p, value): the same quantile, exactly, without sorting a whole group in one task.

    A sketch brackets each place to within a few parts in `accuracy`; values below the bracket are counted,
    and only those inside it are ranked. Groups of less than 2 * accuracy values are ranked whole.
    """
    own = df.where(F.col(value).isNotNull()).select(*by, value)
    ask = lambda p, d: F.percentile_approx(value, F.lit(min(1.0, max(0.0, p + d / accuracy))), accuracy)
    size = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(ask(p, d).alias(f"{s}{i}") for i, p in enumerate(ps) for s, d in (("lo", -5), ("hi", 5))), F.min(value).alias("low"), F.max(value).alias("high"))
    for i in range(len(ps)):
        few = F.col("n") < 2 * accuracy
        size = size.withColumn(f"lo{i}", F.when(few, F.col("low")).otherwise(F.col(f"lo{i}"))).withColumn(f"hi{i}", F.when(few, F.col("high")).otherwise(F.col(f"hi{i}")))
    joined = own.join(size, list(by)) if by else own.crossJoin(F.broadcast(size))
    below = joined.groupBy(*by).agg(*(F.sum(F.when(F.col(value) < F.col(f"lo{i}"), 1).otherwise(0)).alias(f"below{i}") for i in range(len(ps))))
    inside = joined.select(*by, value, "n", F.explode(F.array_compact(F.array(*(F.when(F.col(value).between(F.col(f"lo{i}"), F.col(f"hi{i}")), F.lit(i)) for i in range(len(ps)))))).alias("i"))
    ranked = inside.withColumn("rn", F.row_number().over(Window.partitionBy(*by, "i").orderBy(value)) - 1)
    held = ranked.join(below, list(by)) if by else ranked.crossJoin(F.broadcast(below))
    pick = lambda prefix: F.element_at(F.array(*(F.col(f"{prefix}{i}") for i in range(len(ps)))), F.col("i") + 1)
    place = F.element_at(F.array(*(F.lit(float(p)) for p in ps)), F.col("i") + 1)
    return held.where(F.col("rn") + pick("below") == F.floor(place * (F.col("n") - 1))).select(*by, place.alias("p"), value)
