"""Problem 1: near-duplicate texts by circulant MinHash, banding and exact Jaccard verification.

Shingles are hashed to slots. A first permutation (odd multiplier plus constant) places a shingle, a
second one, shifted circularly by k, ranks it for coordinate k: two permutations make all coordinates.
Coordinates are banded; texts that agree in a band are candidates, and candidates are compared exactly on
their shingle sets.

The circle of slots must be larger than any set on it, or all large texts would agree in the least ranks.
So it grows with the texts: a text takes part in each size class that a near duplicate of it can
fall into, the classes being 16 times apart, each with a circle of 16 slots or more for a shingle. The
ranks of the first class stand in a table, in which those of one shingle under all shifts lie side by side; the
ranks of larger classes are computed.

Scale. Kinds of texts (passages, titles) run together, each row carrying its kind. Normal forms are made
once; copies collapse before banding (map-side), so a copied text of any multiplicity is one row. Bands travel as
two longs a row; both sides of the band join are one exchange, and adaptive execution splits a hot
band. Texts meet pairs for verification in one exchange that both joins read. Every step is a table in the
shared folder, after which its shuffle files are given back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelle.functions import npkern as K
from trovelle.session import pages_for, release, stored

#: Slots of the first size class, and the most shingles of its texts.
UNIVERSE = 1 << 20
FULL = UNIVERSE >> 4
CLASSES = 4
_TABLES: dict[tuple[int, int], np.ndarray] = {}


@dataclass(frozen=True)
class NearDupConfig:
    """rows coordinates a band. A pair at the threshold s is missed with probability (1 - s**rows)**bands:
    0.0015 for words (0.6, 5, 80) and 0.0008 for characters (0.7, 8, 120); at s + 0.05 below 0.0001."""

    shingle: int
    threshold: float
    least: int
    rows: int
    bands: int
    unit: str = "word"
    seed: int = 20


CHUNK = NearDupConfig(shingle=3, threshold=0.6, least=20, rows=5, bands=80)
TITLE = NearDupConfig(shingle=3, threshold=0.7, least=10, rows=8, bands=120, unit="char")
#: The general setting for near duplicates: five words, similarity 0.8.
FIVE = NearDupConfig(shingle=5, threshold=0.8, least=5, rows=8, bands=40)


@dataclass(frozen=True)
class Source:
    """Texts of one kind: the column that names them and the expression of their normal form."""

    kind: str
    df: DataFrame
    key: str
    norm: Column
    cfg: NearDupConfig


def _shifted(k: int, seed: int) -> np.ndarray:
    """Row i holds the ranks of slot i under the shifts 0 .. k-1."""
    if (k, seed) not in _TABLES:
        ranks = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.uint32)
        _TABLES[k, seed] = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:k]]), k)
    return _TABLES[k, seed]


def _computed_ranks(slot: np.ndarray, k: int, bits: int, seed: int) -> np.ndarray:
    """The same for a circle of 2**bits slots: the second permutation is a bijection of bits-bit numbers."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits // 2)
    x = (slot[:, None] + np.arange(k, dtype=np.uint64)[None, :]) & mask
    for odd in (0x9E3779B1 + 2 * seed, 0x85EBCA6B):
        x *= np.uint64(odd)
        x &= mask
        x ^= x >> half
    return x


def _shingles(column: pa.Array, cfg: NearDupConfig) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts in a row, and how many each text has."""
    if cfg.unit == "char":
        points, offsets = K.code_points(column)
        h, lo, hi = K.mix(points.astype(np.uint64) + np.uint64(1)), offsets[:-1], offsets[1:]
    else:
        words = K.Words(*K.byte_buffers(column), K.BLANK)
        h, lo, hi = words.hashes(), words.lo, words.hi
    g = K.grams(h, cfg.shingle)
    at, owner = K.expand_ranges(lo, hi - lo - cfg.shingle + 1)
    return g[at], np.bincount(owner, minlength=len(lo))


def _distinct(column: pa.Array, cfg: NearDupConfig) -> tuple[np.ndarray, np.ndarray]:
    g, n = _shingles(column, cfg)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[keep], np.bincount(owner[keep], minlength=len(n))


def _slots(g: np.ndarray, bits: int, seed: int) -> np.ndarray:
    return (g * np.uint64(0x2545F491) + np.uint64(seed)) & np.uint64((1 << bits) - 1)


def signatures(g: np.ndarray, n: np.ndarray, cfg: NearDupConfig, size_class: int = 0) -> np.ndarray:
    """Circulant MinHash coordinates of texts whose n[i] shingle hashes follow one another in g, one row a text.

    Texts without shingles get the largest number throughout.
    """
    k, bits = cfg.rows * cfg.bands, UNIVERSE.bit_length() - 1 + 4 * size_class
    slot = _slots(g, bits, cfg.seed)
    if size_class == 0:
        table, at_most = _shifted(k, cfg.seed), 8192
        slot = slot.astype(np.int64)
        ranks = lambda a, b: table[slot[a:b]]
    else:
        at_most = 1024
        ranks = lambda a, b: _computed_ranks(slot[a:b], k, bits, cfg.seed)
    out = np.full((len(n), k), 1 << bits, np.uint64 if size_class else np.uint32)
    first = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(n):
        upto = max(at + 1, int(np.searchsorted(first, first[at] + at_most, side="right")) - 1)
        lo, hi = int(first[at]), int(first[upto])
        if upto == at + 1 and hi - lo > at_most:
            for a in range(lo, hi, at_most):
                np.minimum(out[at], ranks(a, min(a + at_most, hi)).min(axis=0), out=out[at])
        elif hi > lo:
            some = np.flatnonzero(n[at:upto]) + at
            out[some] = np.minimum.reduceat(ranks(lo, hi), first[some] - lo, axis=0)
        at = upto
    return out


def size_classes(n: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Of each class: the texts, by their number of different shingles, that take part in it.

    Class c holds up to FULL * 16**c shingles; a similarity of `threshold` lets sizes differ by that factor at most,
    so a text near a border takes part on both sides. No class is empty of what the last one may hold.
    """
    out, low = [], 0.0
    for c in range(CLASSES):
        high = float(FULL) * 16**c if c < CLASSES - 1 else np.inf
        out.append(np.flatnonzero((n >= low * threshold) & (n <= high / threshold)) if c else np.flatnonzero(n <= high / threshold))
        low = high
    return out


def band_rows(column: pa.Array, cfg: NearDupConfig, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text, keys): the band keys of each text in each of its size classes."""
    g, n = _shingles(column, cfg)
    if (n > FULL * cfg.threshold).any():
        g, n = _distinct(column, cfg)
    first = np.concatenate([[0], np.cumsum(n)])
    texts, keys = [], []
    for c, own in enumerate(size_classes(n, cfg.threshold)):
        if not len(own):
            continue
        some = g if len(own) == len(n) else g[K.expand_ranges(first[own], n[own])[0]]
        sig = signatures(some, n[own], cfg, c).reshape(len(own), cfg.bands, cfg.rows)
        h = np.full(sig.shape[:2], salt * 8 + c, np.uint64)
        for r in range(cfg.rows):
            h = (h ^ sig[:, :, r].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(35)
        texts.append(own)
        keys.append(K.mix(h + np.arange(cfg.bands, dtype=np.uint64)[None, :]).view(np.int64))
    return (np.concatenate(texts), np.concatenate(keys)) if texts else (np.zeros(0, int), np.zeros((0, cfg.bands), np.int64))


def _small(batches, rows: int = 2000):
    """Batches of few rows, for the signatures of a batch are held at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def normal_words(text):
    """Lower case, runs of a-z and 0-9, single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normal_title(text):
    """Lower case, each run of white space one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def _long_enough(norm, cfg: NearDupConfig):
    size = F.length(norm) if cfg.unit == "char" else F.length(norm) - F.length(F.replace(norm, F.lit(" "))) + 1
    return (F.length(norm) > 0) & (size >= cfg.least)


def prepare(sources: list[Source]) -> DataFrame:
    """(kind, key, tid, norm): texts long enough, by the hash of their kind and normal form."""
    parts = [
        s.df.select(F.lit(s.kind).alias("kind"), F.col(s.key).cast("string").alias("key"), s.norm.alias("norm"))
        .where(F.col("key").isNotNull() & _long_enough(F.col("norm"), s.cfg))
        .select("kind", "key", F.xxhash64("kind", "norm").alias("tid"), "norm")
        for s in sources
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def classes(texts: DataFrame) -> DataFrame:
    """(tid, kind, norm): one row for each different text."""
    return texts.groupBy("tid").agg(F.min("kind").alias("kind"), F.min("norm").alias("norm"))


def _of_kind(batch: pa.RecordBatch, at: int, kind: str) -> np.ndarray:
    return np.flatnonzero(np.array(batch.column(at).to_pylist(), object) == kind)


def candidates(reps: DataFrame, cfgs: dict[str, NearDupConfig]) -> DataFrame:
    """(a, b), a < b: different texts that agree in a band."""

    def keys(batches):
        for batch in _small(batches):
            for i, (kind, cfg) in enumerate(cfgs.items()):
                own = batch.take(pa.array(_of_kind(batch, 1, kind)))
                if len(own):
                    text, b = band_rows(own.column(2), cfg, i)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, b.size + 1, cfg.bands), pa.int32()), pa.array(b.ravel()))
                    yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(text)), lists], names=["tid", "keys"])

    rows = reps.select("tid", "kind", "norm").mapInArrow(keys, "tid long, keys array<long>").select("tid", F.explode("keys").alias("band"))
    left, right = rows.select("band", F.col("tid").alias("a")), rows.select("band", F.col("tid").alias("b"))
    return left.join(right, "band").where("a < b").select("a", "b").distinct()


def verify(pairs: DataFrame, reps: DataFrame, cfgs: dict[str, NearDupConfig]) -> DataFrame:
    """(kind, a, b, similarity) of the candidates whose exact Jaccard similarity reaches the threshold."""

    def jaccard(x: pa.Array, y: pa.Array, cfg: NearDupConfig) -> np.ndarray:
        (g, n), (h, m) = _distinct(x, cfg), _distinct(y, cfg)
        owner, value = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)]), np.concatenate([g, h])
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        same = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
        shared = np.bincount(owner[1:][same], minlength=len(n))
        return shared / np.maximum(n + m - shared, 1)

    def compare(batches):
        for batch in _small(batches):
            for kind, cfg in cfgs.items():
                own = batch.take(pa.array(_of_kind(batch, 0, kind)))
                if len(own):
                    s = jaccard(own.column(3), own.column(4), cfg)
                    good = pa.array(s >= cfg.threshold - 1e-12)
                    yield pa.RecordBatch.from_arrays([*(own.column(i).filter(good) for i in range(3)), pa.array(s).filter(good)], names=["kind", "a", "b", "similarity"])

    x = reps.select(F.col("tid").alias("a"), F.col("kind").alias("ka"), F.col("norm").alias("na"))
    y = reps.select(F.col("tid").alias("b"), F.col("kind").alias("kb"), F.col("norm").alias("nb"))
    both = pairs.join(x, "a").join(y, "b").where("ka = kb")
    return both.select(F.col("ka").alias("kind"), "a", "b", "na", "nb").mapInArrow(compare, "kind string, a long, b long, similarity double")


class _Links:
    """The links (kind, a, b, similarity) between different texts of the sources, and which keys (members: tid, kind, key) have which text."""

    def __init__(self, sources: list[Source]):
        cfgs = {s.kind: s.cfg for s in sources}
        texts = stored(prepare(sources))
        parts = min(pages_for(texts, ["norm"], 16.0), 20_000)  # where the session has fewer
        reps = stored(classes(texts), parts)
        self.members = stored(texts.select("tid", "kind", "key").distinct())
        release(texts)
        found = stored(candidates(reps, cfgs), parts)
        self.links = stored(verify(found, reps, cfgs), parts)
        release(found)
        release(reps)


def near_pairs(sources: list[Source]) -> DataFrame:
    """(kind, key_a, key_b), key_a < key_b: all pairs of rows of one kind whose texts are near duplicates.

    Null keys and null or short texts have no pairs; rows that repeat a key count once (with each of its
    texts, if these differ); equal texts are pairs too, and all pairs come out, however many copies a text
    has. Other columns play no part. near_links() and near_classes() give the same without expanding copies.
    """
    found = _Links(sources)
    m = found.members
    many = m.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("tid").alias("a"), F.col("tid").alias("b"))
    joined = found.links.select("a", "b").union(many)
    joined = joined.join(m.select(F.col("tid").alias("a"), "kind", F.col("key").alias("x")), "a").join(m.select(F.col("tid").alias("b"), F.col("key").alias("y")), "b")
    return joined.where("x <> y and (a <> b or x < y)").select("kind", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def near_links(sources: list[Source]) -> DataFrame:
    """(kind, text_a, text_b, similarity): one row for each two different texts that are near duplicates, each text named by its smallest key."""
    found = _Links(sources)
    least = found.members.groupBy("tid").agg(F.min("key").alias("key"))
    rows = found.links.join(least.select(F.col("tid").alias("a"), F.col("key").alias("x")), "a").join(least.select(F.col("tid").alias("b"), F.col("key").alias("y")), "b")
    return rows.select("kind", F.least("x", "y").alias("text_a"), F.greatest("x", "y").alias("text_b"), "similarity")


def _state(edges: DataFrame) -> tuple:
    """A count and two folds of hashes, by which two sets of edges are compared."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def components(vertices: DataFrame, links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(tid, class): the smallest tid each vertex is linked to over any number of links.

    Alternating large-star and small-star steps; each round's edges are a table that the next round
    replaces, and only a count and two hashes of them reach the driver. The rounds needed grow with the logarithm of the
    longest chain; if `max_rounds` do not do, it raises rather than give unfinished groups.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = stored(small)
        release(edges)
        edges, before = nxt, state
        state = _state(edges)
        if state == before:
            roots = edges.groupBy("u").agg(F.min("v").alias("class"))
            return vertices.join(roots, vertices["tid"] == roots["u"], "left").select("tid", F.coalesce("class", "tid").alias("class"))
    raise RuntimeError(f"groups are not settled after {max_rounds} rounds")


def near_classes(sources: list[Source]) -> DataFrame:
    """One row a key: kind, key, class_key (the smallest key of its group), n_links (near texts other than its own), n_copies, text_key (the smallest key with the same text)."""
    found = _Links(sources)
    members = found.members
    reps = members.groupBy("tid").agg(F.count(F.lit(1)).alias("n_copies"), F.min("key").alias("least"))
    comp = components(reps.select("tid"), found.links)
    degree = found.links.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("n_links"))
    named = reps.join(comp, "tid").join(degree, "tid", "left")
    first = named.groupBy("class").agg(F.min("least").alias("class_key"))
    rows = members.join(named.select("tid", "class", "n_links", "n_copies", F.col("least").alias("text_key")), "tid").join(first, "class")
    return rows.select("kind", "key", "class_key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies", "text_key")
