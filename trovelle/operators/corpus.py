"""Corpus tables: latest rows, rollups by document, composition and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelle.session import stored


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the greatest by `order` (nulls last). Rows without key are left out."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.where(F.col(key).isNotNull()).withColumn("rn__", F.row_number().over(w)).where("rn__ = 1").drop("rn__")


#: Keys that stand in several rows, so many at most, go to every task of latest_few().
AGAIN = 1_000_000


def latest_few(df: DataFrame, key: str, *order: str) -> DataFrame:
    """latest() where few keys stand in several rows: only the rows of these move."""
    again = stored(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key))
    if again.count() > AGAIN:
        return latest(df, key, *order)
    seen = F.broadcast(again)
    return df.where(F.col(key).isNotNull()).join(seen, key, "left_anti").select(df.columns).unionByName(latest(df.join(seen, key, "left_semi").select(df.columns), key, *order))


def require_unique(df: DataFrame, key: str) -> None:
    """ValueError if a key stands in two rows; names one of them."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key).first()
    if twice is not None:
        raise ValueError(f"{key} is not unique: {twice[0]}")


LATEST_CHUNK = ("chunk_id", "indexed_at", "title", "section", "text")


def latest_chunks(chunks: DataFrame) -> DataFrame:
    return latest(chunks, *LATEST_CHUNK)


def latest_questions(questions: DataFrame) -> DataFrame:
    return latest(questions, "question_id", "created_at", "question", "source_title", "lexical_overlap")


def latest_answers(answers: DataFrame) -> DataFrame:
    return latest(answers, "answer_id", "logged_at", "answer")


def latest_documents(documents: DataFrame) -> DataFrame:
    return latest(documents, "document_id", "ingested_at", "title", "published")


def blocks(documents: DataFrame) -> DataFrame:
    """(document_id, block_idx, page, section, text)."""
    return documents.select("document_id", F.posexplode("blocks").alias("block_idx", "b")).select("document_id", "block_idx", "b.page", "b.section", F.coalesce("b.text", F.lit("")).alias("text"))


def n_pages(blocks_column: str = "blocks") -> Column:
    return F.coalesce(F.array_max(F.transform(blocks_column, lambda b: b["page"])), F.lit(0))


def document_sections(blocks_column: str = "blocks") -> Column:
    """Different section names in order of appearance."""
    return F.array_distinct(F.transform(blocks_column, lambda b: b["section"]))


def full_text(blocks_column: str = "blocks", page: int | None = None) -> Column:
    own = F.filter(blocks_column, lambda b: b["page"] == page) if page is not None else F.col(blocks_column)
    return F.array_join(F.transform(own, lambda b: F.coalesce(b["text"], F.lit(""))), "\n\n")


def citation_label() -> Column:
    return F.concat(F.col("title"), F.lit(" — p."), F.col("page").cast("string"), F.lit(" — "), F.col("section"))


def rollup(chunks: DataFrame) -> DataFrame:
    """By document: chunks, pages, sorted different sections, title and url of the first chunk (by place, then id)."""
    first = F.struct("char_start", "chunk_id")
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.max("page").alias("n_pages"),
        F.sort_array(F.collect_set("section")).alias("sections"),
        F.countDistinct("section").alias("n_sections"),
        F.min_by("title", first).alias("title"),
        F.min_by("source_type", first).alias("source_type"),
    )


def manifest(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("document_id").alias("n_documents"), F.avg("token_count").alias("mean_tokens"))


def running_headers(lines_of: DataFrame, ratio: float = 0.5) -> DataFrame:
    """(document_id, line): short lines among the first or last three of at least `ratio` of a document's pages, from four pages on.

    `lines_of` holds (document_id, page_key, text). Lines never leave their document's group, and a page
    contributes at most six, so no group outgrows a document.
    """
    from trovelle.functions import text as T

    lines = F.filter(F.transform(F.split("text", "\n", -1), T.strip), lambda x: x != "")
    ends = F.array_distinct(F.concat(F.slice("ln", 1, 3), F.slice(F.reverse("ln"), 1, 3)))
    pages = lines_of.withColumn("ln", lines)
    total = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    seen = pages.select("document_id", F.explode(ends).alias("line")).where(F.length("line").between(4, 120))
    counted = seen.groupBy("document_id", "line").agg(F.count(F.lit(1)).alias("k"))
    return counted.join(total, "document_id").where((F.col("n") >= 4) & (F.col("k") >= F.greatest(F.lit(2), F.floor(F.col("n") * ratio)))).select("document_id", "line")
