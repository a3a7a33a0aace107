"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelle.llm import mixing, neardup, packing, pairs, pii, quality, spans, splitting, sql


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _near(spark: SparkSession, sf: str) -> list[neardup.Source]:
    return [
        neardup.Source("chunk", _read(spark, sf, "chunks"), "chunk_id", neardup.normal_words(F.col("text")), neardup.CHUNK),
        neardup.Source("title", _read(spark, sf, "source_documents"), "document_id", neardup.normal_title(F.col("title")), neardup.TITLE),
    ]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_pairs(_near(spark, sf))


def p1_links(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_links(_near(spark, sf)).withColumn("similarity", F.round("similarity", 9))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_classes(_near(spark, sf))


def _common(spark: SparkSession, sf: str) -> list[str]:
    """The list of common words: a fixed table of 113 rows."""
    return [r[0] for r in _read(spark, sf, "common_words").select("word").distinct().where("word is not null").collect()]


def p2_statistics(spark: SparkSession, sf: str) -> DataFrame:
    texts = quality.chunk_texts(_read(spark, sf, "chunks")).union(quality.block_texts(_read(spark, sf, "source_documents")))
    return quality.statistics(quality.latest_counts(texts, _common(spark, sf)))


def p2_ratios(spark: SparkSession, sf: str) -> DataFrame:
    shares = ("mean_word_length", "symbol_share", "ended_line_share", "common_word_share")
    return p2_statistics(spark, sf).select("kind", "ref", "n_words", *(F.round(c, 6).alias(c) for c in shares))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_statistics(spark, sf).where("not is_prose").select("kind", "ref")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    chunks = spans.records(_read(spark, sf, "chunks"), "chunk", "chunk_id", "text", "document_id", "indexed_at")
    questions = spans.records(_read(spark, sf, "eval_questions"), "question", "question_id", "question", None, "created_at")
    return chunks.union(questions)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_runs(_records(spark, sf))


def p3_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    kept = spans.without_repeats(_records(spark, sf))
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["last_word"] - r["first_word"] + 1)
    places = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["first_word"], r["last_word"])), " ")
    return kept.select("kind", "ref", "text", words.alias("removed_words"), places.alias("removed_places"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).where("first_word is not null").select("kind", "ref", "first_word", "last_word")


def p3_shares(spark: SparkSession, sf: str) -> DataFrame:
    shares = spans.shared_shares(_runs(spark, sf))
    latest = F.max(F.struct(F.coalesce("created_at", F.expr("timestamp'1970-01-01 00:00:00'")), F.coalesce("question", F.lit("")), "source_title", "lexical_overlap")).alias("m")
    asked = _read(spark, sf, "eval_questions").groupBy(F.col("question_id").alias("ref")).agg(latest).select("ref", "m.lexical_overlap", F.lit("question").alias("kind"))
    return shares.join(asked, ["kind", "ref"], "left").select("kind", "ref", "n_words", "covered_words", F.round("share", 9).alias("share"), "lexical_overlap")


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    chunks = quality.chunk_texts(_read(spark, sf, "chunks"), "section")
    blocks = quality.block_texts(_read(spark, sf, "source_documents"), "section")
    return splitting.split_texts(chunks.union(blocks), ["kind", "ref"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_pieces(spark, sf).where("piece = 0 and n_pieces > 1").select("kind", "ref")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.pair_defects(_read(spark, sf, "answers"))


def p6_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.pair_evidence(_read(spark, sf, "answers"))


def p7_placements(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_read(spark, sf, "documents"), _read(spark, sf, "containers"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill(p7_placements(spark, sf))


def p8_chosen(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(p8_chosen(spark, sf), _read(spark, sf, "mix_targets"))


def _personal(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_spans(_read(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _personal(spark, sf).select("doc_id", "kind", "value").distinct()


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(_read(spark, sf, "documents"), _personal(spark, sf))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": sql.P1, "p1_links": sql.P1_LINKS, "p2_found": sql.P2_FOUND, "p2_ratios": sql.P2, "p3_found": sql.P3, "p3_shares": sql.P3_SHARES, "p3_deduplicated": sql.P3_DEDUPLICATED, "p4_found": sql.P4}
