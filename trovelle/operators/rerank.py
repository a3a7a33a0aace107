"""Reranking under a per-document quota."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelle.functions import text as T


def keep_first(hits: DataFrame, n: int | None = None) -> DataFrame:
    """No reranking: the first n by rank."""
    return hits if n is None else hits.where(F.col("rank") <= n)


def lexical_pair_score() -> Column:
    """The offline default of the pair scorer: the share of the question's different words that the passage has."""
    q = F.array_distinct(T.tokenize(F.col("question")))
    p = F.array_distinct(T.tokenize(F.concat_ws(" ", "title", "section", "text")))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, p)) / F.size(q)).otherwise(F.lit(0.0))


def with_forward_score(hits: DataFrame, forward: DataFrame, questions: DataFrame) -> DataFrame:
    """hits with pair_score, the value of lexical_pair_score() from the words of a forward table: no text is read."""
    words = F.array_distinct(T.tokenize(F.col("question")))
    ids = F.transform(words, lambda w: F.conv(F.substring(F.sha1(w.cast("binary")), 1, 16), 16, -10).cast("long"))
    asked = questions.select("query_id", ids.alias("q__"))
    both = hits.join(asked, "query_id").join(forward.select("chunk_id", F.col("terms").alias("p__")), "chunk_id")
    score = F.when(F.size("q__") > 0, F.size(F.array_intersect("q__", "p__")) / F.size("q__")).otherwise(F.lit(0.0))
    return both.withColumn("pair_score", score).drop("q__", "p__")


def rerank(hits: DataFrame, n: int = 5, quota: int = 2, scorer: Callable[[], Column] = lexical_pair_score, retriever: str = "hybrid") -> DataFrame:
    """Scores the candidates (query_id, chunk_id, document_id, rank, score, question, title, section, text), then quota and cut.

    At most `quota` passages of a document come first; those over it fill up in order of score. A quota of
    0 or less is none. Ties keep the order they came in. Filter candidates by rank before the call: the
    scorer runs on every row given.
    """
    scored = hits.withColumn("rerank_score", scorer()).withColumnRenamed("rank", "old_rank")
    order = [F.round("rerank_score", 9).desc(), F.col("old_rank")]
    over = F.lit(False)
    if quota > 0:
        scored = scored.withColumn("rn_doc", F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy(*order)))
        over = F.col("rn_doc") > quota
    w = Window.partitionBy("query_id").orderBy(over, *order)
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.withColumn("score", F.col("rerank_score")).withColumn("retriever", F.lit(retriever + "+rerank")).withColumn("moved", F.col("old_rank") - F.col("rank"))
