"""The index on disk, the embedding cache, reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelle.operators import corpus, index

TABLES = ("chunks", "forward", "postings", "term_stats", "corpus_stats", "vectors", "manifest")


class IndexMissing(FileNotFoundError):
    """There is no complete index at the path."""


def save_index(chunks: DataFrame, path: str, config: object | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Writes passages, their words (forward), postings (clustered by term), statistics, vectors and the manifest, last of all.

    The manifest holds the whole configuration, so that an index is never taken for one of another configuration.
    """
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    held = spark.read.parquet(f"{path}/chunks")
    tok = index.tokens(held)
    index.forward(held).write.mode("overwrite").parquet(f"{path}/forward")
    stats = index.corpus_stats(tok)
    index.postings(tok).repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    stats.write.mode("overwrite").parquet(f"{path}/corpus_stats")
    index.term_stats(tok, stats).write.mode("overwrite").parquet(f"{path}/term_stats")
    vectors = embed(held) if embed else index.hashed_vectors(held, "chunk_id", index.contextual_text())
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    settings = json.dumps(asdict(config) if is_dataclass(config) else config or {}, sort_keys=True)
    corpus.manifest(held).withColumn("config", F.lit(settings)).withColumn("built_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/manifest")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index; IndexMissing if one is not there."""
    out = {}
    for name in TABLES:
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as e:
            raise IndexMissing(f"no index at {path}: {name} is missing") from e
    return out


def embed_cached(items: DataFrame, key: str, text: Column, cache_path: str, model: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, v): vectors of items, those of known texts from the cache; what is missing is embedded once a text and appended.

    `embed` takes (cache_key, text) and gives (cache_key, v). A cache that cannot be read counts as empty.
    """
    spark = items.sparkSession
    keyed = items.select(F.col(key), text.alias("text")).withColumn("cache_key", F.sha1(F.concat(F.lit(model + "\n"), "text").cast("binary")))
    try:
        cache = spark.read.schema("model string, cache_key string, v array<double>").parquet(cache_path).where(F.col("model") == model)
        cache.limit(1).count()
    except Exception:
        cache = spark.createDataFrame([], "model string, cache_key string, v array<double>")
    missing = keyed.select("cache_key", "text").where("cache_key is not null").dropDuplicates(["cache_key"]).join(cache, "cache_key", "left_anti")
    made = embed(missing).select(F.lit(model).alias("model"), "cache_key", "v")
    made.write.mode("append").parquet(cache_path)
    known = spark.read.schema("model string, cache_key string, v array<double>").parquet(cache_path).where(F.col("model") == model).dropDuplicates(["cache_key"])
    return keyed.select(key, "cache_key").join(known.select("cache_key", "v"), "cache_key").select(key, "v")


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def latest_report(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modificationTime) of the newest file that matches."""
    return spark.read.format("binaryFile").load(pattern).select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path")).limit(1)
