"""Models to plug in: what they take and give, their registry, and what goes before texts for embedding models."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What embedding models expect before a query or a passage, by a part of their name; the first that fits counts.
QUERY_PREFIXES = {"bge": "Represent this sentence for searching relevant passages: ", "e5": "query: ", "gte": ""}
PASSAGE_PREFIXES = {"e5": "passage: "}

# Fixed value: the order in which answering providers are tried.
PROVIDERS = ("groq", "gemini", "openai", "ollama", "extractive")


class Embedder(Protocol):
    """(rows, key column, text) to (key, v): unit vectors, one a row."""

    def __call__(self, df: DataFrame, key: str, text: Column) -> DataFrame: ...


class Answerer(Protocol):
    """Ranked contexts (query_id, rank, title, section, page, text) to (query_id, answer)."""

    def __call__(self, hits: DataFrame) -> DataFrame: ...


class Judge(Protocol):
    """(answer_id, question, answer, context) to (answer_id, faithfulness, answer_relevance, context_relevance)."""

    def __call__(self, answered: DataFrame) -> DataFrame: ...


def _prefix(model: Column, table: dict[str, str]) -> Column:
    out = F.lit("")
    for part, prefix in reversed(table.items()):
        out = F.when(F.lower(model).contains(part), F.lit(prefix)).otherwise(out)
    return out


def query_prefix(model: Column) -> Column:
    return _prefix(model, QUERY_PREFIXES)


def passage_prefix(model: Column) -> Column:
    return _prefix(model, PASSAGE_PREFIXES)


class Registry:
    """Answering providers: each name has a maker that gives an answerer, or None where it is not available."""

    def __init__(self) -> None:
        self.makers: dict[str, Callable[[], Answerer | None]] = {}

    def register(self, name: str, make: Callable[[], Answerer | None]) -> None:
        self.makers[name.lower()] = make

    def get(self, name: str = "auto") -> tuple[str, Answerer]:
        """The provider asked for if it is available, else the first available one in PROVIDERS."""
        from trovelle.operators.answers import extractive

        wanted = [] if name.lower() == "auto" else [name.lower()]
        for candidate in [*wanted, *PROVIDERS]:
            made = self.makers[candidate]() if candidate in self.makers else None
            if made is not None:
                return candidate, made
        return "extractive", extractive


def context_relevance_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nExcerpts:\n\n"), context)


def answer_relevance_prompt(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nAnswer:\n"), answer)


def faithfulness_prompt(context: Column, answer: Column) -> Column:
    return F.concat(F.lit("Excerpts:\n\n"), context, F.lit("\n\n---\n\nAnswer:\n"), answer)


def question_prompt(title: Column, section: Column, text: Column, most_tokens: int = 600) -> Column:
    from trovelle.functions.text import truncate_tokens

    return F.concat(F.lit("Document: "), title, F.lit("\nSection: "), section, F.lit("\n\nExcerpt:\n"), truncate_tokens(text, most_tokens))


def score_columns(*names: str) -> list[Column]:
    """Scores side by side, those missing as 0."""
    return [F.coalesce(F.col(n), F.lit(0.0)).cast("float").alias(n) for n in names]
