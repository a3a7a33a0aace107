"""Asking, evaluating and comparing as whole plans over tables of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelle.functions import text as T
from trovelle.operators import answers as G
from trovelle.operators import index, metrics, rerank, retrieve
from trovelle.session import stored

OUT_OF_SCOPE = "There is no question here that the documents could answer."


@dataclass(frozen=True)
class AskConfig:
    """Strategy and depths; checked when made."""

    strategy: str = "hybrid"
    rerank: bool = True
    top_k: int = 20
    top_n: int = 5
    alpha: float = 0.5
    quota: int = 2

    def __post_init__(self):
        if self.strategy not in retrieve.STRATEGIES:
            raise ValueError(f"unknown strategy: {self.strategy}")
        if not 1 <= self.top_k <= 100 or not 1 <= self.top_n <= 20:
            raise ValueError("top_k must be 1 to 100, top_n 1 to 20")

    @property
    def label(self) -> str:
        return self.strategy + ("+rerank" if self.rerank else "")


Embedder = Callable[[DataFrame, str, Column], DataFrame]


class _Made(dict):
    """The tables of an index over passages, each written when a search first asks for it; the passages themselves as well, unless they are tables already."""

    def __init__(self, chunks: DataFrame, embed: Embedder, write: bool = False):
        super().__init__({} if write else {"chunks": chunks})
        self.source, self.embed = chunks, embed

    def __missing__(self, name: str) -> DataFrame:
        make = {
            "chunks": lambda: stored(self.source),
            "forward": lambda: stored(index.forward(self.get("chunks", self.source))),
            "corpus_stats": lambda: stored(index.corpus_stats(self["forward"])),
            "vectors": lambda: index.forward_vectors(self["forward"]) if self.embed is index.hashed_vectors else stored(self.embed(self["chunks"], "chunk_id", index.contextual_text())),
        }
        self[name] = make[name]()
        return self[name]


class Index:
    """What a search reads: passages, their words with statistics, their vectors."""

    def __init__(self, tables: dict[str, DataFrame], embed: Embedder = index.hashed_vectors):
        self.tables, self.embed = tables, embed

    @classmethod
    def of(cls, chunks: "DataFrame | Index", embed: Embedder = index.hashed_vectors, write: bool = False) -> "Index":
        """The index of passages that have none, made for as long as the process runs; an index is taken as it is. `write`: passages become a table when their texts are first asked for."""
        return chunks if isinstance(chunks, Index) else cls(_Made(chunks, embed, write), embed)

    def size(self) -> int:
        return self.tables["corpus_stats"].first()["n"]

    def lexical(self, questions: DataFrame, k: int, merged: bool = True) -> DataFrame:
        return retrieve.bm25_of_tables(self.tables, questions, k, merged=merged)

    def dense(self, questions: DataFrame, k: int, merged: bool = True) -> DataFrame:
        return retrieve.vector(self.tables["vectors"], "chunk_id", "v", self.embed(questions, "query_id", F.col("question")), "query_id", "v", k, n=self.size(), merged=merged)


class _Lists:
    """The ranked lists of both arms for some questions: scored once at the greatest depth asked for, cut for lesser ones."""

    def __init__(self, held: Index, questions: DataFrame, depth: int):
        self.held, self.questions, self.depth, self.done = held, questions, depth, {}

    def __call__(self, arm: str, k: int) -> DataFrame:
        if arm not in self.done:
            self.done[arm] = stored(getattr(self.held, arm)(self.questions, self.depth))
        return self.done[arm].where(F.col("rank") <= k)


def search(chunks: DataFrame | Index, questions: DataFrame, cfg: AskConfig = AskConfig(), embed: Embedder = index.hashed_vectors, scorer: Callable[[], Column] = rerank.lexical_pair_score, lists: _Lists | None = None) -> DataFrame:
    """Ranked passages of questions (query_id, question): at most top_n each, with or without reranking.

    `chunks` are passages or an Index of them, whose tables are then read and no text but that of the passages found.
    """
    held = Index.of(chunks, embed)
    arm = lists or (lambda name, k: getattr(held, name)(questions, k))
    hits = retrieve.retrieve(cfg.strategy, lambda k: arm("dense", k), lambda k: arm("lexical", k), cfg.top_k, alpha=cfg.alpha)
    full = hits.select("query_id", "chunk_id", "rank", "score").join(held.tables["chunks"].select("chunk_id", "document_id", "title", "section", "page", "text"), "chunk_id").join(questions.select("query_id", "question"), "query_id")
    if cfg.rerank:
        return rerank.rerank(full, cfg.top_n, cfg.quota, scorer, cfg.strategy)
    return rerank.keep_first(full, cfg.top_n).withColumn("retriever", F.lit(cfg.strategy))


def ask(chunks: DataFrame | Index, questions: DataFrame, cfg: AskConfig = AskConfig(), answerer: Callable[[DataFrame], DataFrame] = G.extractive) -> DataFrame:
    """(query_id, question, answer, confidence, grounded, strategy): one row a question, those out of scope with a fixed text."""
    clean = questions.where("query_id is not null").select("query_id", T.collapse(F.coalesce("question", F.lit(""))).alias("question"))
    outside = T.out_of_scope(F.col("question"))
    hits = stored(search(chunks, clean.where(~outside), cfg))
    said = answerer(hits).select("query_id", G.normalize_markers(F.col("answer")).alias("answer"))
    best = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"))
    rows = clean.join(said, "query_id", "left").join(best, "query_id", "left")
    answer = F.when(outside, F.lit(OUT_OF_SCOPE)).otherwise(F.coalesce("answer", F.lit(G.NOTHING_FOUND)))
    n = F.coalesce("n", F.lit(0))
    return rows.select("query_id", "question", answer.alias("answer"), G.confidence(answer, n, F.coalesce("top", F.lit(0.0)), logit=cfg.rerank).alias("confidence"), G.grounded(answer, n).alias("grounded"), F.lit(cfg.label).alias("strategy"))


def evaluate(chunks: DataFrame | Index, questions: DataFrame, cfg: AskConfig = AskConfig(), lists: _Lists | None = None) -> DataFrame:
    """Retrieval metrics of an arm by granularity over labelled questions (question_id, question, labels).

    Lists are as deep as top_n, so that metrics at greater depths are those at top_n.
    """
    asked = questions.select(F.col("question_id").alias("query_id"), "question")
    hits = stored(search(chunks, asked, cfg, lists=lists).select("query_id", "chunk_id", "document_id", "rank"))
    out = None
    for granularity in ("document", "chunk"):
        ranked = metrics.by_document(hits) if granularity == "document" else hits.select("query_id", F.col("chunk_id").alias("item_id"), "rank")
        one = metrics.summary(metrics.per_query(ranked, metrics.qrels(questions, granularity))).withColumn("granularity", F.lit(granularity)).withColumn("arm", F.lit(cfg.label))
        out = one if out is None else out.unionByName(one)
    return out


def compare(chunks: DataFrame | Index, questions: DataFrame, arms: list[AskConfig] | None = None) -> DataFrame:
    """evaluate() of several arms in one table; the index is made once, and each of the two rankings is scored once for all arms."""
    arms = arms or [AskConfig("vector", False), AskConfig("bm25", False), AskConfig("hybrid", False), AskConfig("hybrid", True)]
    held = Index.of(chunks)
    lists = _Lists(held, questions.select(F.col("question_id").alias("query_id"), "question"), 2 * max(a.top_k for a in arms))
    out = evaluate(held, questions, arms[0], lists)
    for cfg in arms[1:]:
        out = out.unionByName(evaluate(held, questions, cfg, lists))
    return out
