"""The lexical and the vector index as tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelle.functions import text as T


def indexed_text() -> Column:
    return F.concat_ws(" ", "title", "section", "text")


def contextual_text() -> Column:
    """What a passage is embedded as."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("section", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))


def tokens(chunks: DataFrame) -> DataFrame:
    """(chunk_id, tokens, dl): a passage without any word stays, with dl 0."""
    return chunks.select("chunk_id", T.tokenize(indexed_text()).alias("tokens")).withColumn("dl", F.size("tokens"))


def word_id(word: str) -> int:
    """The first 64 bits of the word's sha1, signed."""
    return int.from_bytes(hashlib.sha1(word.encode()).digest()[:8], "big", signed=True)


def forward(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl, terms, tf, and document_id if passages have it): the different words of each passage as sorted 64-bit hashes (word_id()), and how often it has each: what scoring reads in the place of texts.

    Words are those of tokens(), taken in one pass over the texts.
    """

    def run(batches):
        known: dict[str, int] = {}
        inside = np.zeros(256, bool)
        inside[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
        stop = pa.array(T.STOPWORDS, pa.large_string())
        for batch in batches:
            texts = [t.lower().encode() for t in batch.column(1).to_pylist()]
            raw = np.frombuffer(b"\0".join([b"", *texts, b""]), np.uint8)
            letter = inside[raw]
            edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
            starts, ends = edges[::2], edges[1::2]
            owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts)
            offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[letter])).dictionary_encode()
            different = words.dictionary.to_pylist()
            for w in different:
                if w not in known:
                    known[w] = word_id(w)
            ids, flat = np.array([known[w] for w in different], np.int64), words.indices.to_numpy().astype(np.int64)
            kept = ~pc.is_in(words.dictionary, stop).to_numpy(zero_copy_only=False)[flat]
            owner, flat = owner[kept], flat[kept]
            order = np.argsort(ids)
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            pairs = owner * len(ids) + place[flat]
            pairs = np.sort(pairs.astype(np.uint32) if len(texts) * len(ids) < 1 << 32 else pairs)  # half the width sorts in half the time
            first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
            pairs, tf = pairs[first].astype(np.int64), np.diff(np.append(first, len(pairs)))
            lengths = pa.array(np.searchsorted(pairs, np.arange(len(texts) + 1) * len(ids)), pa.int32())
            terms = ids[order][pairs % max(1, len(ids))]
            lists = [pa.ListArray.from_arrays(lengths, pa.array(x)) for x in (terms, tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(owner, minlength=len(texts)).astype(np.int32)), *lists, *batch.columns[2:]], names=["chunk_id", "dl", "terms", "tf", *also])

    also = [c for c in ("document_id",) if c in chunks.columns]
    return chunks.select("chunk_id", indexed_text().alias("text"), *also).mapInArrow(run, "chunk_id string, dl int, terms array<long>, tf array<int>" + "".join(f", {c} string" for c in also))


def forward_vectors(forward: DataFrame, dim: int = 64) -> DataFrame:
    """hashed_vectors() of the passages of a forward table: the words of contextual_text() are those of indexed_text(), and the hash of a word begins with its cell."""

    def run(batches):
        for batch in batches:
            owner = np.repeat(np.arange(len(batch)), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            cell = ((batch.column(1).flatten().to_numpy() >> 40) & 0xFFFFFF) % dim
            v = np.bincount(owner * dim + cell, batch.column(2).flatten().to_numpy(), minlength=len(batch) * dim).reshape(len(batch), dim)
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v = v / np.where(norm > 0, norm, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim), pa.int32()), pa.array(v.ravel())), *batch.columns[3:]], names=["chunk_id", "v", *also])

    also = [c for c in ("document_id",) if c in forward.columns]
    return forward.select("chunk_id", "terms", "tf", *also).mapInArrow(run, "chunk_id string, v array<double>" + "".join(f", {c} string" for c in also))


def postings(tok: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, dl)."""
    return tok.select("chunk_id", "dl", F.explode("tokens").alias("term")).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(tok: DataFrame) -> DataFrame:
    return tok.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def term_stats(tok: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf). A term counts once a passage, before the shuffle."""
    df = tok.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def check_vectors(items: DataFrame, vectors: DataFrame, key: str, column: str = "v") -> None:
    """ValueError unless every item has one vector and all vectors have one length."""
    r = vectors.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("keys"), F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high")).first()
    missing = items.select(key).join(vectors.select(key), key, "left_anti").limit(1).count()
    if missing or r["n"] != r["keys"] or r["low"] != r["high"]:
        raise ValueError(f"vectors do not fit: {r['n']} vectors of {r['keys']} items, lengths {r['low']} to {r['high']}, items without vector: {bool(missing)}")


def hashed_vectors(df: DataFrame, key: str, text: Column, dim: int = 64) -> DataFrame:
    """(key, v): the same embedding as dense unit vectors; a text without words has the zero vector. Words are hashed once a worker."""
    tok = df.where(F.col(key).isNotNull()).select(F.col(key), T.tokenize(text).alias("t"))

    def run(batches):
        cells: dict[str, int] = {}
        for batch in batches:
            owner = np.repeat(np.arange(len(batch)), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            words = batch.column(1).flatten().to_pylist()
            for w in set(words) - cells.keys():
                cells[w] = int(hashlib.sha1(w.encode()).hexdigest()[:6], 16) % dim
            flat = np.bincount(owner * dim + np.fromiter((cells[w] for w in words), np.int64, len(words)), minlength=len(batch) * dim).astype(float)
            v = flat.reshape(len(batch), dim)
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v = v / np.where(norm > 0, norm, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim), pa.int32()), pa.array(v.ravel()))], names=[key, "v"])

    return tok.mapInArrow(run, f"{key} {tok.dtypes[0][1]}, v array<double>")


def hashed_embedding(chunks: DataFrame, key: str, text: Column, dim: int = 64) -> DataFrame:
    """(key, dim_idx, value): unit-length feature-hashed term counts in sparse rows, the offline default of the embedder."""
    term = chunks.select(key, F.explode(T.tokenize(text)).alias("term"))
    cell = F.conv(F.substring(F.sha1(F.col("term").cast("binary")), 1, 6), 16, 10).cast("long") % dim
    counts = term.groupBy(key, cell.cast("int").alias("dim_idx")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, key).select(key, "dim_idx", (F.col("n") / F.col("norm")).alias("value"))
