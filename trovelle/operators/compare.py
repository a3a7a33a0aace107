"""The comparison of arms: lists of both retrievers go to their question once, and there become places in the lists of all arms and metrics, many questions at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelle.operators import metrics
from trovelle.operators.retrieve import SEGMENT, _places, unpacked
from trovelle.session import partitions

#: The arms of per_query(), in this order.
ARMS = ("vector", "bm25", "hybrid", "hybrid_weighted")


def _order(keys: tuple[np.ndarray, ...], names: pa.Array) -> np.ndarray:
    """Rows by the keys, then by name, which is looked at only where the keys are the same."""
    order = np.lexsort(keys[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    if not same.any():
        return order
    tied = order[np.append(same, False) | np.append(False, same)]
    place = np.zeros(len(order), np.int64)
    place[tied] = _places(names.take(pa.array(tied)))
    return np.lexsort((place, *keys[::-1]))


def _within(q: np.ndarray) -> np.ndarray:
    """The number of each row, from 0, among those of its question; q is sorted."""
    return np.arange(len(q)) - np.searchsorted(q, q)


def _reached(of: np.ndarray, n: np.ndarray, s: np.ndarray, questions: int, depth: int) -> np.ndarray:
    """For each list, a score that the `depth` best of all lists of its question reach at least; lists have n scores each, the best first."""
    each = -(-depth // np.bincount(of, minlength=questions)[of])  # if all lists have so many, they are `depth` together
    last = np.append(np.cumsum(n) - n, len(s))[:-1] - 1
    bound = np.full(questions, np.inf)
    np.minimum.at(bound, of, np.where(n >= each, s[np.minimum(last + each, len(s) - 1)] if len(s) else -np.inf, -np.inf))
    full = n >= depth
    np.maximum.at(bound, of[full], s[(last + depth)[full]])
    return bound[of]


def _scaled(q: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Scores scaled to 0..1 within each question; q is sorted."""
    if not len(q):
        return score
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    n = np.diff(np.append(start, len(q)))
    low, high = (np.repeat(f.reduceat(score, start), n) for f in (np.minimum, np.maximum))
    alike = high - low < 1e-9
    return np.where(alike, 1.0, (score - low) / np.where(alike, 1.0, high - low))


def _metrics(q: np.ndarray, rank: np.ndarray, document: np.ndarray, wanted: np.ndarray, n_relevant: np.ndarray, documents: int, ks: tuple[int, ...]) -> list[np.ndarray]:
    """The columns of metrics.per_query() for one list by documents; `wanted` are question * documents + document of the labels."""
    order = np.lexsort((rank, q))
    key = q[order] * documents + document[order]
    first = np.sort(np.unique(key, return_index=True)[1])  # each document at its best place
    key = key[first]
    q = key // documents
    place, hit = _within(q) + 1, np.isin(key, wanted)
    questions = len(n_relevant)
    n = np.bincount(q, minlength=questions)
    q, place = q[hit], place[hit]
    at = _within(q)
    out = []
    for k in ks:
        top = place <= k
        h = np.bincount(q[top], minlength=questions)
        gain = np.bincount(q[top], 1 / np.log2(place[top] + 1), questions)
        ideal = np.cumsum(1 / np.log2(np.arange(2, k + 2)))[np.minimum(n_relevant, k) - 1]
        out += [(h > 0).astype(float), h / np.maximum(1, np.minimum(n, k)), h / n_relevant, gain / ideal]
    rr = np.zeros(questions)
    rr[q[at == 0]] = 1 / place[at == 0]
    return [*out, rr, np.bincount(q, (at + 1) / place, questions) / np.maximum(1, np.minimum(n_relevant, n))]


def per_query(dense: DataFrame, lexical: DataFrame, questions: DataFrame, slices: Column, n: int, k: int = 20, pool: int = 2, alpha: float = 0.5, constant: int = 60, ks: tuple[int, ...] = metrics.KS) -> DataFrame:
    """(arm, slice, query_id, metrics by document) of the four ARMS for each labelled question and slice of it.

    `dense` and `lexical` are lists of retrieve that are not merged: several a question, with the pool * k best of each part
    of the passages. Ranks, fusion and ties are those of
    retrieve.places(), metrics those of metrics.per_query_of_arms(). `n` is how many passages there are.
    """
    labels = F.array_distinct(F.array_compact("relevant_document_ids"))
    own = questions.where(F.size(labels) > 0).select(F.col("question_id").alias("query_id"), F.lit(2).alias("kind"), slices.alias("slices"), F.transform(labels, lambda d: F.xxhash64(d)).alias("labels"))
    rows = dense.withColumn("kind", F.lit(0)).unionByName(lexical.withColumn("kind", F.lit(1))).unionByName(own, allowMissingColumns=True)
    names = [*(f"{m}_{x}" for x in ks for m in ("hit", "precision", "recall", "ndcg")), "rr", "ap"]
    depth = pool * k

    def run(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        del parts
        ids = t["query_id"].combine_chunks().dictionary_encode()
        of, kind = ids.indices.to_numpy().astype(np.int64), t["kind"].to_numpy()
        asked = np.flatnonzero(kind == 2)
        if not len(asked):
            return
        number = np.full(len(ids.dictionary), -1)
        number[of[asked]] = np.arange(len(asked))
        of = number[of]
        label = t["labels"].combine_chunks().take(pa.array(asked))
        n_relevant = label.value_lengths().to_numpy().astype(np.int64)
        lists = []
        for arm in (0, 1):
            some = np.flatnonzero((kind == arm) & (of >= 0))
            n, items, documents, s = unpacked(t.take(pa.array(some)))
            own = np.flatnonzero(s >= np.repeat(_reached(of[some], n, s, len(asked), depth), n) - 4e-9)
            q, s, items, documents = np.repeat(of[some], n)[own], s[own], items.take(pa.array(own)), documents[own]
            order = _order((q, -np.round(s, 9)), items)
            order = order[_within(q[order]) < depth]
            lists.append((q[order], s[order], items.take(pa.array(order)), documents[order]))
        (dq, ds, dn, dd), (lq, ls, ln, ld) = lists
        chunk = pa.chunked_array([dn, ln]).combine_chunks().dictionary_encode()
        code, size = chunk.indices.to_numpy().astype(np.int64), max(1, len(chunk.dictionary))
        key, first, to = np.unique(np.concatenate([dq, lq]) * size + code, return_index=True, return_inverse=True)
        q, document, chunk = key // size, np.concatenate([dd, ld])[first], chunk.dictionary.take(pa.array(key % size))
        never = np.iinfo(np.int64).max
        ranks, scaled = [], []
        for at, (own_q, score) in zip((to[: len(dq)], to[len(dq) :]), ((dq, ds), (lq, ls))):
            rank, part = np.full(len(key), never), np.zeros(len(key))
            rank[at], part[at] = _within(own_q) + 1, _scaled(own_q, score)
            ranks.append(rank)
            scaled.append(part)
        share = [np.where(r < never, 1 / (constant + np.minimum(r, depth)), 0.0) for r in ranks]
        for order in (np.lexsort((ranks[1], ranks[0], -np.round(share[0] + share[1], 12), q)), _order((q, -np.round(alpha * scaled[0] + (1 - alpha) * scaled[1], 9)), chunk)):
            rank = np.empty(len(key), np.int64)
            rank[order] = _within(q[order]) + 1
            ranks.append(rank)
        values, document = np.unique(np.concatenate([document, label.flatten().to_numpy()]), return_inverse=True)
        wanted = np.repeat(np.arange(len(asked)), n_relevant) * len(values) + document[len(key) :]
        who, slices = t["query_id"].combine_chunks().take(pa.array(asked)), t["slices"].combine_chunks().take(pa.array(asked))
        for arm, rank in zip(ARMS, ranks):
            top = rank <= k
            found = _metrics(q[top], rank[top], document[: len(key)][top], wanted, n_relevant, len(values), ks)
            out = pa.table([pa.array([arm] * len(asked)), slices, who, *(pa.array(c) for c in found)], names=["arm", "slices", "query_id", *names])
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    kinds = dict(rows.dtypes)
    spread = max(partitions(rows.sparkSession), questions.count() * depth * (1 + n // SEGMENT) // 1_000_000)
    per = rows.repartition(spread, "query_id").mapInArrow(run, f"arm string, slices array<string>, query_id {kinds['query_id']}, " + ", ".join(f"{n} double" for n in names))
    return per.select("arm", F.explode("slices").alias("slice"), "query_id", *names)
