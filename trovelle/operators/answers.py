"""Prompts, extractive answers, citations and confidence as column expressions over ranked contexts."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelle.functions import text as T
from trovelle.operators.metrics import markers

# Dollars a million tokens (prompt, completion); models not listed cost nothing.
PRICES = {
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
    "gpt-4.1-mini": (0.40, 1.60),
}
# Fixed value: the phrase by which an answer refuses.
REFUSAL = "do not contain information"
# Fixed value: what is said where there is no context; refusal metrics know the phrase.
NOTHING_FOUND = "The information could not be found."


def context_block(most_tokens: int = 700) -> Column:
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" | page "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(" | section: "), F.coalesce("section", F.lit("")))
    return F.concat(head, F.lit("\n"), T.truncate_tokens(F.coalesce("text", F.lit("")), most_tokens))


def contexts(hits: DataFrame, most_tokens: int = 700) -> DataFrame:
    """(query_id, context): the ranked passages as numbered blocks. A question has few of them, for they are the reranked ones."""
    rows = F.sort_array(F.collect_list(F.struct("rank", context_block(most_tokens).alias("b"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["b"]), "\n\n---\n\n").alias("context"))


def answer_prompt(question: Column, context: Column) -> Column:
    """The prompt of a grounded answer, or one that asks for a refusal where there is no context."""
    ask = F.concat(F.lit("Excerpts:\n\n"), context, F.lit("\n\n---\n\nQuestion: "), question, F.lit("\n\nUse the excerpts alone and mark each claim with the number of its excerpt, as in [1]. Say so if they hold no answer."))
    none = F.concat(F.lit("Question: "), question, F.lit("\n\nThere are no excerpts. Say that the provided documents do not contain information on this."))
    return F.when(context.isNull() | (context == ""), none).otherwise(ask)


def extractive(hits: DataFrame, n_contexts: int = 3, n_sentences: int = 2) -> DataFrame:
    """(query_id, answer): the first sentences of the best passages, their header included, each with its marker."""
    flat = T.collapse(F.concat(F.coalesce("title", F.lit("")), F.lit(" | page "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(" | section: "), F.coalesce("section", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    part = F.concat(F.array_join(F.slice(T.sentences(flat), 1, n_sentences), " "), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    rows = F.sort_array(F.collect_list(F.struct("rank", part.alias("p"))))
    return hits.where(F.col("rank") <= n_contexts).groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["p"]), " ").alias("answer"))


def normalize_markers(text: Column) -> Column:
    """Other ways of citing as [n]: lenticular brackets, source words, several numbers in one bracket."""
    text = F.regexp_replace(text, r"【\s*([0-9]{1,2})\s*(?:†[^】]*)?】", "[$1]")
    text = F.regexp_replace(text, r"(?i)\[\s*(?:source|ref|citation)\s*[: ]\s*([0-9]{1,2})\s*\]", "[$1]")
    for _ in range(6):  # one number less in each grouped bracket a time
        text = F.regexp_replace(text, r"\[\s*([0-9]{1,2})\s*,\s*([0-9]{1,2}(?:\s*,\s*[0-9]{1,2})*)\s*\]", "[$1][$2]")
    return text


def citations(answered: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, marker, chunk_id, snippet): each different marker that points at a context."""
    said = answered.select("query_id", F.explode(F.array_distinct(markers(F.col("answer")))).alias("marker"))
    return said.join(hits.select("query_id", F.col("rank").alias("marker"), "chunk_id", T.snippet(F.col("text"), 400).alias("snippet")), ["query_id", "marker"])


def confidence(answer: Column, n_contexts: Column, top_score: Column, logit: bool = False) -> Column:
    """0.5 strength of retrieval + 0.35 share of cited statements + 0.15 breadth of sources, to three places; 0 for refusals and without contexts."""
    from trovelle.operators.metrics import citation_coverage

    strength = 1 / (1 + F.exp(-top_score)) if logit else F.greatest(F.lit(0.0), F.least(F.lit(1.0), top_score))
    valid = F.size(F.filter(F.array_distinct(markers(answer)), lambda m: m.between(1, n_contexts)))
    value = 0.5 * strength + 0.35 * citation_coverage(answer) + 0.15 * F.least(valid / 3.0, F.lit(1.0))
    refused = F.lower(answer).contains(REFUSAL)
    return F.when(answer.isNull() | refused | (n_contexts <= 0), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 3))


def grounded(answer: Column, n_contexts: Column) -> Column:
    return F.coalesce(~F.lower(answer).contains(REFUSAL) & F.exists(markers(answer), lambda m: m.between(1, n_contexts)), F.lit(False))


def cost(model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    out = F.lit(0.0)
    for name, (p, c) in PRICES.items():
        out = F.when(model == name, (prompt_tokens * p + completion_tokens * c) / 1e6).otherwise(out)
    return out


def json_object(text: Column) -> Column:
    """The outermost {...} of a text, null unless it is valid JSON."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), body)


def rolling_usage(events: DataFrame, time: str, amount: str, seconds: int = 60, bucket_seconds: int = 3600) -> DataFrame:
    """Adds used and n: sum and count over the last `seconds` up to each row, per user_id; rows just `seconds` old are out.

    A user is cut into buckets of time, so that one with a third of all rows is many groups; the rows of a
    bucket's last `seconds` are seen by the next one too. Rows without a time are left out.
    """
    span, length = seconds * 1_000_000, bucket_seconds * 1_000_000
    if bucket_seconds < seconds:
        raise ValueError("a bucket must be as long as the window at least")
    timed = events.withColumn("t__", F.unix_micros(F.col(time).cast("timestamp"))).where("t__ is not null")
    own = F.floor(F.col("t__") / length)
    late = F.pmod("t__", F.lit(length)) > length - span
    seen = timed.withColumn("b__", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("own__", F.col("b__") == own)
    w = Window.partitionBy("user_id", "b__").orderBy("t__").rangeBetween(-(span - 1), 0)
    summed = seen.withColumn("used", F.sum(amount).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return summed.where("own__").drop("t__", "b__", "own__")


def admit(arrivals: list[tuple], tokens: float, requests: int, window: float = 60.0) -> list[float]:
    """When each (arrival, estimate) or (arrival, estimate, actual) is let through by a limiter of `tokens` and `requests` a rolling window: the live schedule, a fold.

    An estimate above the budget passes when the window is empty. Once the actual use is known it counts in the window in the
    place of the estimate, if it is more: providers count by tokenizers of their own.
    """
    held: deque[tuple[float, float]] = deque()
    clock, out = 0.0, []
    for at, estimate, *actual in arrivals:
        clock = max(clock, at)
        while held and clock - held[0][0] >= window:
            held.popleft()
        while held and (sum(n for _, n in held) + estimate > tokens or len(held) >= requests):
            clock = max(clock, held.popleft()[0] + window)
        held.append((clock, max([estimate, *actual])))
        out.append(clock)
    return out
