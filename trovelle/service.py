"""What a service or a command line offers, as functions of tables; errors are exceptions of their own."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelle.operators import corpus
from trovelle.operators.chunking import ChunkConfig, chunk_documents
from trovelle.plans.pipeline import AskConfig, Index, ask, compare, evaluate, search
from trovelle.session import ship
from trovelle.sources import loaders, store


class NotFound(LookupError):
    """There is no such document."""


class BadRequest(ValueError):
    """The request is out of bounds."""


class Service:
    """An index in memory of its path; reload() after it was built anew."""

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self.spark, self.path = spark, path
        self.reload()

    def reload(self) -> None:
        self.tables = store.load_index(self.spark, self.path)
        self.index = Index(self.tables)

    def health(self) -> dict:
        return {k: v for k, v in self.tables["manifest"].first().asDict().items() if k != "built_at"}

    def _asked(self, question: str) -> DataFrame:
        if not question or len(question.strip()) < 3:
            raise BadRequest("a question has at least three characters")
        return self.spark.createDataFrame([("q", question)], "query_id string, question string")

    def query(self, question: str, cfg: AskConfig = AskConfig()) -> DataFrame:
        return ask(self.index, self._asked(question), cfg)

    def retrieve(self, question: str, cfg: AskConfig = AskConfig()) -> DataFrame:
        hits = search(self.index, self._asked(question), cfg)
        return hits.select("rank", "chunk_id", "document_id", "title", "page", "section", F.substring("text", 1, 600).alias("preview"), F.round("score", 4).alias("score")).orderBy("rank")

    def documents(self, source_type: str | None = None, limit: int = 50, offset: int = 0) -> tuple[int, DataFrame]:
        """How many there are before paging, and the page by title."""
        r = corpus.rollup(self.tables["chunks"])
        r = r.where(F.col("source_type") == source_type) if source_type else r
        return r.count(), r.orderBy("title", "document_id").offset(offset).limit(limit)

    def document(self, document_id: str) -> DataFrame:
        own = self.tables["chunks"].where(F.col("document_id") == document_id)
        if own.isEmpty():
            raise NotFound(document_id)
        return own.orderBy("char_start", "chunk_id")


def ingest(spark: SparkSession, source: str, path: str) -> None:
    """Files to a table of documents."""
    ship(spark)
    loaders.read_documents(spark, source).write.mode("overwrite").parquet(path)


def process(spark: SparkSession, documents: DataFrame, path: str, cfg: ChunkConfig = ChunkConfig()) -> None:
    """Documents to index: passages, tables."""
    held = documents.select("document_id", "title", "source", "source_type", "url")
    store.save_index(chunk_documents(documents, cfg).join(held, "document_id"), path, cfg)


def build(spark: SparkSession, source: str, path: str, cfg: ChunkConfig = ChunkConfig()) -> None:
    """Files to index: documents, passages, tables."""
    ship(spark)
    process(spark, loaders.read_documents(spark, source), path, cfg)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="trovelle")
    sub = p.add_subparsers(dest="command", required=True)
    for name, more in (("index", ("source", "path")), ("ingest", ("source", "path")), ("process", ("documents", "path")), ("evaluate", ("path", "questions")), ("ask", ("path", "question")), ("info", ("path",)), ("compare", ("path", "questions"))):
        s = sub.add_parser(name)
        for m in more:
            s.add_argument(m)
        s.add_argument("--chunk-tokens", type=int, default=500)
        s.add_argument("--overlap", type=int, default=75)
        s.add_argument("--strategy", default="hybrid")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("trovelle").getOrCreate()
    if a.command == "index":
        build(spark, a.source, a.path, ChunkConfig(a.chunk_tokens, a.overlap))
        return
    if a.command == "ingest":
        ingest(spark, a.source, a.path)
        return
    if a.command == "process":
        process(spark, spark.read.parquet(a.documents), a.path, ChunkConfig(a.chunk_tokens, a.overlap))
        return
    service = Service(spark, a.path)
    if a.command == "info":
        print(json.dumps(service.health()))
    elif a.command == "ask":
        service.query(a.question, AskConfig(a.strategy)).select("answer", "confidence", "grounded").show(truncate=False)
    else:
        q = spark.read.schema("question_id string, question string, relevant_document_ids array<string>, relevant_chunk_ids array<string>").json(a.questions)
        (compare(service.index, q) if a.command == "compare" else evaluate(service.index, q, AskConfig(a.strategy))).show(truncate=False)


if __name__ == "__main__":
    main()
