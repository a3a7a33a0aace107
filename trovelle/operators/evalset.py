"""Evaluation questions: overlap with their sources, self-containment, sampling, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelle.functions import text as T

# What makes a question lean on its passage.
ANAPHORIC = (
    r"(?i)(?:^|[^\p{L}\p{N}_])(?:this|these|that|the)\s+(?:[a-z]+(?:ic|al|ive|ed|ing|ary|ent)\s+){0,3}"
    r"(?:study|studies|review|reviews|paper|article|trial|trials|document|report|excerpt|passage|guideline|text|analysis|work|research|figure|table|author|cohort|dataset|survey)s?(?:[^\p{L}\p{N}_]|$)"
)
POINTING = r"(?i)(?:^|[^\p{L}\p{N}_])(?:above|below|mentioned earlier|the following)(?:[^\p{L}\p{N}_]|$)"


def lexical_overlap(question: Column, passage: Column) -> Column:
    """Share of the question's different words that the passage has; 0 for a question without words."""
    q = F.array_distinct(T.tokenize(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.tokenize(passage))) / F.size(q)).otherwise(F.lit(0.0))


def is_self_contained(question: Column) -> Column:
    return F.coalesce((F.size(T.words(question)) >= 4) & ~question.rlike(ANAPHORIC) & ~question.rlike(POINTING), F.lit(False))


def backfill_overlap(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """lexical_overlap anew against the first labelled passage; questions whose passage is missing keep theirs."""
    gold = questions.withColumn("gold", F.try_element_at("relevant_chunk_ids", F.lit(1)))
    held = chunks.select(F.col("chunk_id").alias("gold"), F.col("text").alias("gold_text"))
    joined = gold.join(held, "gold", "left")
    return joined.withColumn("lexical_overlap", F.when(F.col("gold_text").isNotNull(), lexical_overlap(F.col("question"), F.col("gold_text"))).otherwise(F.col("lexical_overlap"))).drop("gold", "gold_text")


def slices(threshold: float = 0.5) -> Column:
    """The slices a question belongs to: all, and low or high by its overlap (a null one counts as 0)."""
    return F.array(F.lit("all"), F.when(F.coalesce("lexical_overlap", F.lit(0.0)) <= threshold, F.lit("low")).otherwise(F.lit("high")))


def sample_chunks(chunks: DataFrame, n: int, least_tokens: int = 180, seed: int = 13) -> DataFrame:
    """(chunk_id, document_id, turn): n passages in turns over the documents, in an order that only the seed sets.

    References and abbreviations and passages under least_tokens are left out.
    """
    good = chunks.where((F.col("token_count") >= least_tokens) & ~F.coalesce(F.lower("section").rlike("^(?:reference|abbreviation)"), F.lit(False)))
    h = lambda c: F.sha1(F.concat(F.lit(f"{seed}:"), F.col(c)).cast("binary"))
    turns = good.withColumn("turn", F.row_number().over(Window.partitionBy("document_id").orderBy(h("chunk_id"), "chunk_id")))
    return turns.where(F.col("turn") <= n).orderBy("turn", h("document_id"), "document_id").limit(n).select("chunk_id", "document_id", "turn")


def generation_sample(questions: DataFrame, limit: int | None) -> DataFrame:
    """The first max(limit // 4, 1) unanswerable questions and answerable ones up to the limit, by question_id; all without a limit."""
    if limit is None:
        return questions
    open_ = F.coalesce("unanswerable", F.lit(False))
    probes = questions.where(open_).orderBy("question_id").limit(max(limit // 4, 1))
    return questions.where(~open_).orderBy("question_id").limit(max(limit - probes.count(), 0)).unionByName(probes)


def assemble(generated: DataFrame, chunks: DataFrame, curated: DataFrame, most_overlap: float = 0.75) -> DataFrame:
    """(question_id, question, relevant_document_ids, relevant_chunk_ids, lexical_overlap, unanswerable): an evaluation set.

    `generated` has (position, chunk_id, question), one row a sampled passage; questions that lean on their
    passage or copy it are left out, the others are numbered by position. `curated` has (position, question,
    unanswerable) and no labels.
    """
    held = chunks.select("chunk_id", "document_id", "text")
    made = generated.where("question is not null").join(held, "chunk_id").withColumn("lexical_overlap", lexical_overlap(F.col("question"), F.col("text")))
    made = made.where(is_self_contained(F.col("question")) & (F.col("lexical_overlap") <= most_overlap)).select(
        F.format_string("syn_%04d", "position").alias("question_id"),
        "question",
        F.array("document_id").alias("relevant_document_ids"),
        F.array("chunk_id").alias("relevant_chunk_ids"),
        "lexical_overlap",
        F.lit(False).alias("unanswerable"),
    )
    none = F.array().cast("array<string>")
    own = curated.select(
        F.format_string("cur_%04d", "position").alias("question_id"),
        "question",
        none.alias("relevant_document_ids"),
        none.alias("relevant_chunk_ids"),
        F.lit(0.0).alias("lexical_overlap"),
        F.coalesce("unanswerable", F.lit(False)).alias("unanswerable"),
    )
    return made.unionByName(own)
