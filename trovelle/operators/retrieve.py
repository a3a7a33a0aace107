"""Retrieval: lexical and vector top-k from the tables of an index, and fusion of ranked lists.

Questions are a stated set that runs against all passages. They go out in batches of bounded size, as
a broadcast variable, those with the same words or vector as one; passages stay where they are: a task scores them by segments, in single precision against
the k-th best score that it knows of each question, scores exactly what may reach that, and gives up the best k a question and segment. So what is shuffled grows with questions
times segments, not with matches. A few questions at a time go another way to the same rows: they read the
postings of their own words alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovelle.functions import text as T
from trovelle.functions.npkern import byte_buffers, expand_ranges
from trovelle.operators import index
from trovelle.session import partitions, stored

QUESTIONS_A_BATCH = 100_000
#: Items that a task holds at a time.
SEGMENT = 131_072
#: Bytes of question vectors that a batch sends to each worker at most.
BATCH_BYTES = 64_000_000
#: So many questions or fewer read the postings of their words.
FEW = 16


def _batches(questions: DataFrame, key: str, at_most: int = QUESTIONS_A_BATCH) -> list[DataFrame]:
    """Parts of bounded size, by the hash of the key."""
    n = questions.count()
    parts = (n + at_most - 1) // at_most or 1
    return [questions if parts == 1 else questions.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class Best:
    """The k best items of each question so far: by score to nine places, then by item."""

    def __init__(self, questions: int, k: int):
        self.k, self.bar = k, np.full(questions, -np.inf)
        self.held: pa.Table | None = None
        self.new: list[pa.Table] = []
        self.waiting, self.limit = 0, max(4 * questions * k, 100_000)

    def block(self, first: int, scores: np.ndarray, items: pa.Array, above: float) -> None:
        """Scores of the questions from `first` on (rows) for a block of items (columns); those not over `above` do not count."""
        bar = self.bar[first : first + len(scores)]
        if scores.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        q, c = np.nonzero((scores >= bar[:, None] - 1e-9) & (scores > above))
        if len(q):
            self.new.append(pa.table([pa.array(q + first), pa.array(scores[q, c]), items.take(pa.array(c))], names=["q", "s", "item"]))
            self.waiting += len(q)
            if self.waiting > self.limit:
                self.settle()

    def settle(self) -> pa.Table | None:
        parts = [*([self.held] if self.held is not None else []), *self.new]
        if parts:
            t = pa.concat_tables(parts)
            t = t.append_column("r", pa.array(-np.round(t["s"].to_numpy(), 9)))
            t = t.take(pc.sort_indices(t, [("q", "ascending"), ("r", "ascending"), ("item", "ascending")])).drop_columns(["r"])
            q = t["q"].to_numpy()
            start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
            self.held = t.filter(pa.array(place < self.k)).combine_chunks()
            full = np.flatnonzero(place == self.k - 1)
            self.bar[q[full]] = t["s"].to_numpy()[full]
            self.new, self.waiting = [], 0
        return self.held

    def rows(self, ids: list, names: list[str], kind: pa.DataType, size: int = 10_000):
        """Record batches of (question, item, score)."""
        t = self.settle()
        for at in range(0, len(t) if t is not None else 0, size):
            part = t.slice(at, size)
            own = pa.array([ids[i] for i in part["q"].to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([own, part["item"].combine_chunks(), part["s"].combine_chunks()], names=names)


def top_k(hits: DataFrame, k: int, group: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Adds rank (from 1) by score to nine places, then item, and keeps the first k of each group."""
    w = Window.partitionBy(group).orderBy(F.round("score", 9).desc(), F.col(item))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _asked(questions: DataFrame, expand: bool) -> DataFrame:
    text = T.expand_query(F.col("question")) if expand else F.col("question")
    return questions.where("query_id is not null").select("query_id", F.array_distinct(T.tokenize(text)).alias("terms")).where(F.size("terms") > 0)


def bm25(chunks: DataFrame, questions: DataFrame, k: int = 20, expand: bool = True, k1: float = 1.5, b: float = 0.75, lam: float = 1.0) -> DataFrame:
    """bm25_of_tables() over passages (chunk_id, title, section, text) that have no index yet: their words are taken once, for this search."""
    forward = stored(index.forward(chunks))
    tables = {"forward": forward, "term_stats": None, "corpus_stats": index.corpus_stats(forward)}
    return bm25_of_tables(tables, questions, k, expand, k1, b, lam)


def bm25_of_tables(tables: dict, questions: DataFrame, k: int = 20, expand: bool = True, k1: float = 1.5, b: float = 0.75, lam: float = 1.0, merged: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, rank) for questions (query_id, question) over the tables forward, term_stats and corpus_stats, and postings if there.

    Scores are BM25 sums over the different query words times the matched share of them to the power lam;
    words that no passage has count in the share. Questions without matches, null ones among them, have no rows.
    The texts of passages are not read. Not `merged`, it gives the lists (query_id, PACKED) of parts of the passages, with a
    hash of the document of each, which forward has to hold then.
    """
    spark = questions.sparkSession
    stats = tables["corpus_stats"].first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    asked = _asked(questions, expand)
    kind = dict(asked.dtypes)["query_id"]
    found = []
    for part in _batches(asked, "query_id"):
        rows = part.toArrow().combine_chunks()  # at most QUESTIONS_A_BATCH
        if not len(rows):
            continue
        words = rows["terms"].combine_chunks().flatten().dictionary_encode()
        ids = np.array([index.word_id(w) for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
        few = len(rows) <= FEW and tables.get("postings") is not None and merged
        wanted = np.unique(ids)
        if tables.get("term_stats") is not None and few:
            terms = spark.createDataFrame([(t,) for t in words.dictionary.to_pylist()], "term string")
            known = tables["term_stats"].select("term", "df").join(F.broadcast(terms), "term").collect()
            found += [_from_postings(tables["postings"], part, known, n, avgdl, k1, b, lam)] if known else []
            continue
        df = _documents_of(tables["forward"], wanted)
        wanted, df = wanted[df > 0], df[df > 0]
        if not len(wanted):
            continue
        size = rows["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(rows)), size)
        place = np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)
        owner, place = owner[wanted[place] == ids], place[wanted[place] == ids]
        order = np.lexsort((place, owner))
        own = np.split(place[order], np.searchsorted(owner, np.arange(1, len(rows))))
        group: dict[tuple[bytes, int], int] = {}  # questions with the same words are scored once
        of = [(group.setdefault((t.tobytes(), m), len(group)), q) for q, t, m in zip(rows["query_id"].to_pylist(), own, size.tolist()) if len(t)]
        held = [(i, np.frombuffer(t, place.dtype), m) for (t, m), i in group.items()]
        shared = spark.sparkContext.broadcast((wanted, np.log(1 + (n - df + 0.5) / (df + 0.5)), held))
        read = _together(tables["forward"].select("chunk_id", "dl", "terms", "tf", *([] if merged else [_document()])), n)
        lists = read.mapInArrow(_lexical_block(shared, avgdl, k, k1, b, lam, _segment_of(tables["forward"], n)), f"query_id long, {'items array<string>, scores array<double>' if merged else PACKED}")
        found.append(_named(_merged(lists, len(held), k, "chunk_id", n) if merged else lists, of, rows.schema.field("query_id").type, kind))
    if not merged:
        return _union(found) if found else spark.createDataFrame([], f"query_id {kind}, {PACKED}")
    ranked = [f for f in found if "rank" in f.columns] + [top_k(f, k) for f in found if "rank" not in f.columns]
    if not ranked:
        return spark.createDataFrame([], f"query_id {kind}, chunk_id string, score double, rank int")
    return _union(ranked)


def _named(ranked: DataFrame, of: list[tuple], own: pa.DataType, kind: str) -> DataFrame:
    """The rows of numbered groups of questions for each question of theirs, from (group, question) of one batch of questions."""
    spark = ranked.sparkSession
    named = spark.createDataFrame(pa.table([pa.array([g for g, _ in of], pa.int64()), pa.array([q for _, q in of], own)], names=["g__", "own__"]))
    return ranked.join(F.broadcast(named), F.col("query_id") == F.col("g__")).select(F.col("own__").cast(kind).alias("query_id"), *ranked.columns[1:])


#: Lists that are not merged, as the bytes of their arrays, which pass from task to task as they are: the items one after another and how long each is, hashes of their documents, scores.
PACKED = "items binary, lengths binary, documents binary, scores binary"


def _packed(ends: np.ndarray, items: pa.Array, scores: np.ndarray) -> list[pa.Array]:
    """The columns of PACKED from items with their documents; `ends` are those of the lists, from 0."""
    data, offsets = byte_buffers(items.field(0))
    documents = items.field(1).to_numpy(zero_copy_only=False)

    def column(values: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    return [column(data, offsets[ends]), column(np.diff(offsets).astype(np.int32), ends * 4), column(documents, ends * 8), column(scores, ends * 8)]


def unpacked(lists: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """From the columns of PACKED: how many items each list has, items, documents and scores of all."""

    def joined(column: pa.ChunkedArray) -> np.ndarray:
        own = column.cast(pa.large_binary()).combine_chunks()
        own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
        offsets = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, own.offset * 8) if len(own) else np.zeros(1, np.int64)
        return np.frombuffer(own.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy() if offsets[-1] else np.zeros(0, np.uint8)

    data = {c: joined(lists[c]) for c in ("items", "lengths", "documents", "scores")}
    offsets = np.concatenate([[0], np.cumsum(data["lengths"].view(np.int32), dtype=np.int64)])
    items = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data["items"]))
    return pc.binary_length(lists["scores"]).to_numpy().astype(np.int64) // 8, items, data["documents"].view(np.int64), data["scores"].view(np.float64)


def _document() -> Column:
    return F.xxhash64("document_id").alias("document")


def _item(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    """The items of a table, with the hash of their document if it has that."""
    own = [table.column(c) for c in (name, "document") if c in table.schema.names]
    own = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own]
    return own[0] if len(own) == 1 else pa.StructArray.from_arrays(own, names=[name, "document"])


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _together(items: DataFrame, n: int) -> DataFrame:
    """As few tasks as there are cores, or as many as keep a task at some SEGMENTs: what a task gives does not grow with its items."""
    return items.coalesce(_tasks(items.sparkSession, n))


def _tasks(spark: SparkSession, n: int) -> int:
    return max(spark.sparkContext.defaultParallelism, n // (4 * SEGMENT))


def _documents_of(forward: DataFrame, ids: np.ndarray) -> np.ndarray:
    """How many passages have each of the hashed words (sorted)."""
    shared = forward.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        ids = shared.value
        count = np.zeros(len(ids), np.int64)
        for batch in batches:
            own = batch.column(0).flatten().to_numpy()
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            count += np.bincount(at[ids[at] == own], minlength=len(ids))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["at", "n"])

    found = forward.select("terms").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(ids), np.int64)
    df[found["at"].to_numpy()] = found["n"].to_numpy()
    return df


def _merged(lists: DataFrame, questions: int, k: int, item: str, n: int) -> DataFrame:
    """(query_id, item, score, rank): the k best of the lists (query_id, items, scores) that tasks give for each question."""
    kind, qkind = dict(lists.dtypes)["items"][6:-1], dict(lists.dtypes)["query_id"]
    spark = lists.sparkSession
    parts = max(partitions(spark), questions * k * (1 + n // SEGMENT) // 2_000_000)

    def run(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        ids = t["query_id"].combine_chunks().dictionary_encode()
        best = Best(len(ids.dictionary), k)
        length = t["items"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        own = np.repeat(ids.indices.to_numpy(), length)
        best.new.append(pa.table([pa.array(own.astype(np.int64)), t["scores"].combine_chunks().flatten(), t["items"].combine_chunks().flatten()], names=["q", "s", "item"]))
        t = best.settle()
        q = t["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q) + 1
        done = pa.table([ids.dictionary.take(pa.array(q)), t["item"], t["s"], pa.array(place.astype(np.int32))], names=["query_id", item, "score", "rank"])
        yield from done.combine_chunks().to_batches(max_chunksize=10_000)

    return lists.repartition(parts, "query_id").mapInArrow(run, f"query_id {qkind}, {item} {kind}, score double, rank int")


def _from_postings(postings: DataFrame, asked: DataFrame, known: list, n: int, avgdl: float, k1: float, b: float, lam: float) -> DataFrame:
    """Scores from the postings of the asked words, which lie together by term, so that little else is read."""
    spark = asked.sparkSession
    idf = [(r["term"], float(np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5)))) for r in known]
    words = asked.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("size")).join(F.broadcast(spark.createDataFrame(idf, "term string, idf double")), "term")
    own = postings.where(F.col("term").isin([t for t, _ in idf])).join(F.broadcast(words), "term")  # the words of FEW questions
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    summed = own.groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("m"), F.first("size").alias("size"))
    return summed.select("query_id", "chunk_id", F.round(F.col("w") * F.pow(F.col("m") / F.col("size"), F.lit(lam)), 12).alias("score"))


def _segment_of(items: DataFrame, n: int) -> int:
    """Rows of a segment such that those of a task are about as large as each other: what a question costs besides its rows is paid once a segment."""
    own = n / _tasks(items.sparkSession, n)
    return max(SEGMENT, int(1.25 * own / -(-own // (1.25 * SEGMENT)))) if own else SEGMENT


def _segments(batches, most: int | None = None):
    """Tables of about `most` rows, SEGMENT if not given."""
    held, rows, most = [], 0, most or SEGMENT
    for batch in batches:
        for at in range(0, len(batch), most):
            held.append(batch.slice(at, most))
            rows += len(held[-1])
            if rows >= most:
                table, held, rows = pa.Table.from_batches(held).combine_chunks(), [], 0
                yield table
                del table
    if rows:
        table, held = pa.Table.from_batches(held).combine_chunks(), []
        yield table


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint8) if not len(counts) or counts.max() <= 255 else counts


def _known(batches, ids: np.ndarray, norm_of: Callable[[np.ndarray], np.ndarray], most: int | None = None):
    """Segments of passages: ids, norms, and for each asked word of a passage its place in `ids`, the passage and the count; other words are not held."""
    held, rows, most = [], 0, most or SEGMENT

    def joined():
        items = pa.concat_arrays([h[0] for h in held])
        columns = list(zip(*(h[1:] for h in held)))
        held.clear()
        return items, *(np.concatenate(columns.pop(0)) for _ in range(4))

    for batch in batches:
        for at in range(0, len(batch), most):
            part = batch.slice(at, most)
            chunk, dl, terms, tf = _item(part, "chunk_id"), *(part.column(part.schema.get_field_index(c)) for c in ("dl", "terms", "tf"))
            term = terms.flatten().to_numpy()
            row = np.minimum(np.searchsorted(ids, term), len(ids) - 1)
            own = np.flatnonzero(ids[row] == term)
            owner = np.repeat(np.arange(rows, rows + len(part), dtype=np.int32), terms.value_lengths().to_numpy(zero_copy_only=False))
            held.append((chunk, norm_of(dl.to_numpy(zero_copy_only=False).astype(float)), row[own].astype(np.uint32), owner[own], _narrow(tf.flatten().to_numpy()[own])))
            rows += len(part)
            if rows >= most:
                rows = 0
                yield joined()  # not held here while it is worked on
    if rows:
        yield joined()


def _places(items: pa.Array) -> np.ndarray:
    """The place of each item in their order, which settles ties."""
    items = items.field(0) if pa.types.is_struct(items.type) else items
    place = np.empty(len(items), np.int64)
    place[pc.sort_indices(items).to_numpy()] = np.arange(len(items))
    return place


def _first(scores: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k best, by score to nine places, then place."""
    own = np.arange(len(scores))
    if len(scores) > k:
        own = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 2e-9)
    return own[np.lexsort((place[own], -np.round(scores[own], 9)))[:k]]


def _given(ids: list, kind, rows: list[tuple[int, np.ndarray, np.ndarray]], items: pa.Array, size: int = 1000):
    """Record batches of (question, items, scores) from (question, rows of items, scores)."""
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        ends = np.cumsum([0, *(len(r[1]) for r in part)])
        own, scores = items.take(pa.array(np.concatenate([r[1] for r in part]))), np.concatenate([r[2] for r in part])
        if pa.types.is_struct(items.type):
            columns, names = _packed(ends, own, scores), ["items", "lengths", "documents", "scores"]
        else:
            columns, names = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (own, pa.array(scores))], ["items", "scores"]
        yield pa.RecordBatch.from_arrays([pa.array([ids[r[0]] for r in part], kind), *columns], names=["query_id", *names])


class _Sums:
    """Rows of whole numbers over all items of a segment, in a grid, and their sums; questions that begin with the same rows share the sums of these."""

    #: The grid's columns have so many items, and these are laid out so again.
    DEPTH = 8

    def __init__(self, rows: int, n: int):
        self.n = n
        self.columns = -(-n // self.DEPTH**2) * self.DEPTH
        self.sums = np.zeros((rows, self.columns * self.DEPTH), np.uint16)
        self.stack, self.path = [np.zeros(self.columns * self.DEPTH, np.uint16)], ()

    def summed(self, rows: tuple[int, ...]) -> np.ndarray:
        """The sums of some rows; those that the last question began with are there already."""
        depth = 0
        while depth < min(len(rows), len(self.path)) and rows[depth] == self.path[depth]:
            depth += 1
        for i in range(depth, len(rows)):
            if i + 1 == len(self.stack):
                self.stack.append(np.empty_like(self.stack[0]))
            np.add(self.stack[i], self.sums[rows[i]], out=self.stack[i + 1])
        self.path = rows
        return self.stack[len(rows)]

    def over(self, grid: np.ndarray, highest: np.ndarray, least: int) -> np.ndarray:
        """The items whose sums are `least` or more; `highest` are those of the grid's columns."""
        at = (highest >= least).nonzero()[0]
        hit = (grid.take(at, axis=1) >= least).ravel().nonzero()[0]
        return hit // len(at) * self.columns + at[hit % len(at)] if len(at) else at

    def reached(self, highest: np.ndarray, k: int) -> int:
        """What the sums of k items reach at least."""
        few = highest.reshape(self.DEPTH, -1).max(axis=0)
        few = few if len(few) > 4 * k else highest
        return int(np.partition(few, len(few) - k)[len(few) - k]) if len(few) > k else 0


class _Counted:
    """The queries whose vectors are small whole multiples of one number: scored by sums of as many rows, one a cell of the vectors."""

    #: So many summands at most, and candidates that are scored exactly together.
    MOST, TOGETHER = 64, 20_000

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        least = np.where(matrix > 0, matrix, np.inf).min(axis=1, initial=np.inf)
        self.unit = np.where(np.isfinite(least), least, 1.0)
        ratio = matrix / self.unit[:, None]
        times = np.rint(ratio)
        self.size = times.sum(axis=1)
        fits = (matrix >= 0).all(axis=1) & (np.abs(ratio - times) < 1e-9).all(axis=1) & (self.size > 0) & (self.size <= self.MOST)
        self.others, own = np.flatnonzero(~fits), np.flatnonzero(fits)
        self.longest = np.sqrt((times[own] ** 2).sum(axis=1).max(initial=0.0))
        often = np.argsort(-(times[own] > 0).sum(axis=0), kind="stable")  # the cells that most queries have come first
        self.often = often
        turned = times[own][:, often].astype(np.int64)
        self.queries = sorted((tuple(np.repeat(np.arange(len(often)), t).tolist()), q) for t, q in zip(turned, own.tolist()))

    def best(self, v: np.ndarray, longest: float, place: np.ndarray, k: int, bars: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(query, items, scores): the k best items of each query; raises the bars.

        Rows are rounded up, so the sum for an item is never under its score, and over it by less than one a summand:
        the k best are among those whose sums are at most so much under the k-th greatest.
        """
        held = _Sums(len(self.often), len(v))
        scale = 60_000 / max(self.longest * longest, 1e-9)
        for at in range(0, len(v), 8192):
            part = v[at : at + 8192]
            held.sums[:, at : at + len(part)] = np.ceil(part.T[self.often] * scale)
        rows, waiting, n = [], [], 0

        def settle():
            q = np.repeat([x for x, _ in waiting], [len(c) for _, c in waiting])
            c = np.concatenate([c for _, c in waiting])
            s = np.einsum("ij,ij->i", self.matrix[q], v[c])
            turn = np.repeat(np.arange(len(waiting)), [len(c) for _, c in waiting])
            order = np.lexsort((place[c], -np.round(s, 9), turn))
            turn, c, s = turn[order], c[order], s[order]
            at = np.arange(len(turn)) - np.searchsorted(turn, turn)
            turn, c, s, at = (x[at < k] for x in (turn, c, s, at))
            cuts = np.flatnonzero(np.diff(turn)) + 1
            for first, own, scores in zip(turn[np.append(0, cuts)].tolist(), np.split(c, cuts), np.split(s, cuts)):
                x = waiting[first][0]
                rows.append((x, own, scores))
                if len(own) == k:
                    bars[x] = max(bars[x], scores[-1])

        for cells, q in self.queries:
            found, slack = held.summed(cells), len(cells) + 1
            grid = found.reshape(held.DEPTH, held.columns)
            highest = grid.max(axis=0)
            least = max(0, held.reached(highest, k) - slack)
            if bars[q] > 0:
                least = max(least, int((bars[q] - 2e-9) / self.unit[q] * scale * (1 - 1e-9)) - 1)
            own = held.over(grid, highest, least)
            if len(own) > k:
                sums = found[own]
                own = own[sums >= int(np.partition(sums, len(own) - k)[len(own) - k]) - slack]
            own = own[own < len(v)]
            if len(own):
                waiting.append((q, own))
                n += len(own)
                if n > self.TOGETHER:
                    settle()
                    waiting, n = [], 0
        if waiting:
            settle()
        return rows


class _Words(_Sums):
    """The asked words of a segment of passages, by word: passages, counts and weights; frequent words also as rows over all passages.

    Weights are whole numbers here, rounded up, in units of 1 / scale and with EACH added for every word: what sums of
    them cannot reach is not reached. Sums of whole numbers are the same in any order and can be taken back, so questions
    that share frequent words share the sums of these.
    """

    #: What a matched word adds to the sum of weights that candidates are found by, and the share of passages from which a word is frequent.
    EACH, FREQUENT, ROWS = 2.0, 1 / 20, 512

    def __init__(self, held: list[np.ndarray], idf: np.ndarray, k1: float, asked: np.ndarray, offsets: np.ndarray):
        """`held` are norms, words, passages and counts of _known(); it is emptied, so that they go when they are sorted."""
        norm, row, owner, tf = held
        held.clear()
        n, words, self.norm, self.idf, self.k1 = len(norm), len(idf), norm, idf, k1
        order = np.argsort(row.astype(np.uint16), kind="stable")  # numbers of 16 bits are sorted in time that grows with their count
        if words > 1 << 16:
            order = order[np.argsort((row[order] >> 16).astype(np.uint16), kind="stable")]
        self.tf = tf.astype(np.uint8 if not len(tf) or tf.max() <= 255 else np.int32)[order]
        del tf
        self.owner, row = owner[order], row[order]
        del owner, order
        self.start = np.searchsorted(row, np.arange(words + 1, dtype=row.dtype))
        weight = np.empty(len(row), np.float32)
        for at in range(0, len(row), 1 << 20):
            own = slice(at, at + (1 << 20))
            weight[own] = idf[row[own]] * self.tf[own] * (k1 + 1) / (self.tf[own] + norm[self.owner[own]]) * (1 + 1e-6)  # no less in single precision
        df = np.diff(self.start)
        self.top = np.zeros(words)
        some = np.flatnonzero(df)
        if len(some):
            self.top[some] = np.maximum.reduceat(weight, self.start[some])
        highest = np.where(df > 0, self.top + self.EACH, 0)[asked]
        total = np.add.reduceat(highest, offsets[:-1])
        size = np.diff(offsets)
        self.scale = 60_000 / max(np.quantile(total, 0.99), highest.max(initial=0), 1.0)
        self.narrow = total * self.scale + size <= 65_535  # these have sums of 16 bits, others of 32
        self.weight = np.empty(len(row), np.uint16)
        for at in range(0, len(row), 1 << 20):
            self.weight[at : at + (1 << 20)] = np.ceil((weight[at : at + (1 << 20)].astype(float) + self.EACH) * self.scale)
        del weight, row
        often = np.flatnonzero(df > max(64, n * self.FREQUENT))
        often = often[np.argsort(-df[often], kind="stable")[: self.ROWS]]
        self.often, self.row = often, np.full(words, -1)
        self.row[often] = np.arange(len(often))
        super().__init__(len(often), n)
        self.counts = np.zeros((len(often), n), self.tf.dtype)
        for i, t in enumerate(often):
            own = slice(self.start[t], self.start[t + 1])
            self.sums[i, self.owner[own]] = self.weight[own]
            self.counts[i, self.owner[own]] = self.tf[own]

    def frequent(self, terms: np.ndarray) -> tuple[int, ...]:
        """The rows of the frequent ones of a question's words, the most frequent first."""
        rows = self.row[terms]
        return tuple(np.sort(rows[rows >= 0]).tolist())

    def wide(self, rows: tuple[int, ...]) -> np.ndarray:
        """The sums of some rows where 16 bits do not hold them."""
        found = np.zeros(self.columns * self.DEPTH, np.uint32)
        for i in rows:
            found += self.sums[i]
        return found

    def exact(self, terms: np.ndarray, own: np.ndarray, size: int, lam: float) -> np.ndarray:
        """Scores of some passages."""
        rows = self.row[terms]
        if (rows >= 0).all():
            tf = self.counts[rows[:, None], own].astype(float)
        else:
            tf, often = np.zeros((len(terms), len(own))), np.flatnonzero(rows >= 0)
            tf[often] = self.counts[rows[often][:, None], own]
            narrow = own.astype(self.owner.dtype)
            for i in np.flatnonzero(rows < 0).tolist():
                lo, hi = self.start[terms[i]], self.start[terms[i] + 1]
                at = np.minimum(self.owner[lo:hi].searchsorted(narrow), hi - lo - 1) + lo
                tf[i] = self.tf[at] * (self.owner[at] == own)
        weight = self.idf[terms][:, None] * tf * (self.k1 + 1) / (tf + self.norm[own])
        share = (tf > 0).sum(axis=0) / size
        return np.round(weight.sum(axis=0) * (share if lam == 1 else share**lam), 12)

    def least(self, terms: int, size: int, lam: float, bar: float) -> int:
        """What the sum of weights for a passage is at least if its score reaches the bar."""
        m = np.arange(1, terms + 1)
        return max(1, int(((bar - 2e-9) * (size / m) ** lam + self.EACH * m).min() * self.scale * (1 - 1e-9)) - 1) if bar > 0 else 1

    def together(self, rows: tuple[int, ...], asked: list[tuple[int, np.ndarray, int, float]], lam: float, k: int, place: np.ndarray):
        """The k best passages, by score and `place`, for questions (number, terms, size, bar) that all have the frequent words of `rows`, and other words of their own: (number, passages, scores).

        The order of passages by the shared words alone is the same for all of them. A passage without other words of a
        question is among its k best only if it is among the k best by the shared ones, since those before it only gain
        by other words; so besides these k only the passages of other words are left.
        """
        asked = sorted(asked, key=lambda a: a[0])
        names, size, bar = np.array([a[0] for a in asked]), np.array([float(a[2]) for a in asked]), np.array([a[3] for a in asked])
        longest, count = int(size.max()), np.array([len(a[1]) for a in asked])
        common = asked[0][1][self.row[asked[0][1]] >= 0]
        shared, scores = self.best(common, rows, True, longest, lam, k, 0.0)
        if len(scores) >= k:
            bar = np.maximum(bar, np.partition(scores, len(scores) - k)[len(scores) - k] * (longest / size) ** lam * (1 - 1e-12) - 1e-11)
        m = np.arange(1, count.max() + 1)
        least = (bar[:, None] - 2e-9) * (size[:, None] / m) ** lam + self.EACH * m
        least = np.where(bar > 0, np.where(m <= count[:, None], least, np.inf).min(axis=1) * self.scale * (1 - 1e-9) - 2, 1)
        term, q = np.concatenate([a[1] for a in asked]), np.repeat(np.arange(len(asked)), count)
        rare = self.row[term] < 0
        term, q = term[rare], q[rare]
        most = np.bincount(q, np.ceil((self.top[term] + self.EACH) * self.scale) + 1, len(asked))
        at, of = expand_ranges(self.start[term], self.start[term + 1] - self.start[term])
        found, q, term = self.summed(rows), q[of], term[of]
        some = np.flatnonzero(found[self.owner[at]] + most[q] >= least[q])
        at, q, term = at[some], q[some], term[some]
        key, of = np.unique(q * self.n + self.owner[at], return_inverse=True)
        q, own = key // self.n, key % self.n
        some = found[own] + np.bincount(of, self.weight[at], len(key)) >= least[q]
        tf = self.tf[at].astype(float)
        weight = np.bincount(of, self.idf[term] * tf * (self.k1 + 1) / (tf + self.norm[self.owner[at]]), len(key))[some]
        matched = np.bincount(of, minlength=len(key))[some]
        q, own = q[some], own[some]
        both = ((np.arange(len(asked)) * self.n)[:, None] + shared).ravel()
        if len(key):
            both = both[key[np.minimum(key.searchsorted(both), len(key) - 1)] != both]
        q, own = np.concatenate([q, both // self.n]), np.concatenate([own, both % self.n])
        different, of = np.unique(own, return_inverse=True)
        tf = self.counts[np.array(rows)[:, None], different].astype(float)
        often = (self.idf[self.often[list(rows)]][:, None] * tf * (self.k1 + 1) / (tf + self.norm[different])).sum(axis=0)[of]
        often[: len(weight)] += weight
        share = (tf > 0).sum(axis=0)[of]
        share[: len(matched)] += matched
        share = share / size[q]
        scores = np.round(often * (share if lam == 1 else share**lam), 12)
        some = np.flatnonzero((scores >= bar[q] - 2e-9) & (scores > 0))
        q, own, scores = q[some], own[some], scores[some]
        order = np.lexsort((place[own], -np.round(scores, 9), q))
        q = q[order]
        some = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, own, scores = q[some], own[order][some], scores[order][some]
        if len(q):
            cuts = np.flatnonzero(np.diff(q)) + 1
            yield from zip(names[q[np.append(0, cuts)]].tolist(), np.split(own, cuts), np.split(scores, cuts))

    def best(self, terms: np.ndarray, rows: tuple[int, ...], narrow: bool, size: int, lam: float, k: int, bar: float) -> tuple[np.ndarray, np.ndarray]:
        """Passages that may be among the k best or reach the bar, all that do among them, and their scores.

        A passage with m of a question's `size` words and the sum w of their weights scores w (m / size) ** lam. Where that
        reaches the bar, w + EACH m is at least the least of bar (size / m) ** lam + EACH m over all m.
        """
        found = self.summed(rows) if narrow else self.wide(rows)
        rare = [slice(self.start[t], self.start[t + 1]) for t in terms[self.row[terms] < 0].tolist()]
        for own in rare:
            found[self.owner[own]] += self.weight[own]
        grid = found.reshape(self.DEPTH, self.columns)
        highest = grid.max(axis=0)

        def least_for(bar: float) -> int:
            return self.least(len(terms), size, lam, bar)

        def raised(own: np.ndarray) -> float:
            """The bar after some passages were scored, the most promising ones."""
            if len(own) > 2 * k:
                own = own[np.argpartition(found[own], len(own) - 2 * k)[len(own) - 2 * k :]]
            return max(bar, np.partition(self.exact(terms, own, size, lam), len(own) - k)[len(own) - k]) if len(own) >= k else bar

        if self.columns > k and not bar > 0:
            bar = raised(self.over(grid, highest, max(1, self.reached(highest, k))))
        own = self.over(grid, highest, least_for(bar))
        if len(own) > 6 * k:
            bar = raised(own)
            own = own[found[own] >= least_for(bar)]
        for at in rare:
            found[self.owner[at]] -= self.weight[at]
        scores = self.exact(terms, own, size, lam) if len(own) else np.zeros(0)
        some = np.flatnonzero((scores >= bar - 2e-9) & (scores > 0))
        return own[some], scores[some]


def _found(words: _Words, held: list[tuple[tuple[int, ...], int, np.ndarray]], place: np.ndarray, sizes: list[int], lam: float, k: int, bars: np.ndarray):
    """(question, passages, scores) of the k best from sorted (frequent rows, question, terms)."""
    for often, group in itertools.groupby(held, lambda h: h[0]):
        alike, alone = [], []
        for _, q, terms in group:
            (alike if often and words.narrow[q] else alone).append((q, terms, sizes[q], bars[q]))
        if len(alike) == 1:
            alone, alike = alone + alike, []
        for at in range(0, len(alike), 256):
            yield from words.together(often, alike[at : at + 256], lam, k, place)
        for q, terms, size, bar in alone:
            own, scores = words.best(terms, often, bool(words.narrow[q]), size, lam, k, bar)
            some = _first(scores, place[own], k)
            yield q, own[some], scores[some]


def _lexical_block(shared, avgdl: float, k: int, k1: float, b: float, lam: float, most: int | None = None) -> Callable:
    """Scores segments of passages question by question, those with the same frequent words after one another."""

    def run(batches):
        ids, idf, questions = shared.value
        asked, sizes = np.concatenate([t for _, t, _ in questions]), [m for _, _, m in questions]
        offsets = np.cumsum([0, *(len(t) for _, t, _ in questions)])
        bars = np.zeros(len(questions))
        for items, *held in _known(batches, ids, lambda dl: k1 * (1 - b + b * dl / avgdl), most):
            words = _Words(held, idf, k1, asked, offsets)
            place, rows, there = _places(items), [], np.diff(words.start) > 0
            held = []
            for q, (_, terms, _) in enumerate(questions):
                terms = terms[there[terms]]
                if len(terms):
                    held.append((words.frequent(terms), q, terms))
            held.sort(key=lambda h: h[:2])
            for q, own, scores in _found(words, held, place, sizes, lam, k, bars):
                if len(own):
                    rows.append((q, own, scores))
                if len(own) == k:
                    bars[q] = max(bars[q], scores.min())
            del words, held, place  # not held while the next task has the lists
            yield from _given([q for q, _, _ in questions], None, rows, items)

    return run


def vector(items: DataFrame, item: str, embedding: str, queries: DataFrame, query: str, query_embedding: str, k: int = 20, keep_self: bool = True, n: int | None = None, merged: bool = True) -> DataFrame:
    """(query_id, item, score, rank): exact top-k by inner product over unit vectors; nulls and vectors of another length have no rows.

    Filters on items go before the call, so that they narrow what is ranked. `n` is how many items there are, if known.
    Not `merged`, it gives lists as bm25_of_tables() does, of items that have a document_id.
    """
    dim_of = queries.where(F.col(query_embedding).isNotNull()).select(F.max(F.size(query_embedding))).first()[0]
    kind, qkind = dict(items.dtypes)[item], dict(queries.dtypes)[query]
    good = items.where(F.col(item).isNotNull() & (F.size(embedding) == (dim_of or -1))).select(item, F.col(embedding).cast("array<double>").alias("v"), *([] if merged else [_document()]))
    found = []
    own = queries.where(F.col(query).isNotNull() & (F.size(query_embedding) == (dim_of or -1))).select(F.col(query).alias("q"), F.col(query_embedding).cast("array<double>").alias("v"))
    for part in _batches(own, "q", max(1, min(QUESTIONS_A_BATCH, BATCH_BYTES // (8 * (dim_of or 1))))):
        rows = part.toArrow()  # at most QUESTIONS_A_BATCH vectors and BATCH_BYTES
        if len(rows):
            n = items.count() if n is None else n
            ids, matrix = rows["q"].to_pylist(), _flat(rows["v"]).astype(float).reshape(len(rows), -1)
            group: dict[bytes, int] = {}
            if keep_self:  # queries with the same vector are scored once
                of = [(group.setdefault(v.tobytes(), len(group)), q) for q, v in zip(ids, matrix)]
                held = (list(range(len(group))), np.frombuffer(b"".join(group)).reshape(len(group), -1))
            else:
                held = (ids, matrix)
            shared = items.sparkSession.sparkContext.broadcast(held)
            best = _together(good, n).mapInArrow(_vector_block(shared, k, keep_self, item, _segment_of(good, n)), f"query_id {'long' if keep_self else qkind}, {f'items array<{kind}>, scores array<double>' if merged else PACKED}")
            best = _merged(best, len(held[0]), k, item, n) if merged else best
            found.append(_named(best, of, rows.schema.field("q").type, qkind) if keep_self else best)
    if not found:
        return items.sparkSession.createDataFrame([], f"query_id {qkind}, {item} {kind}, score double, rank int" if merged else f"query_id {qkind}, {PACKED}")
    return _union(found)


def _vector_block(shared, k: int, keep_self: bool, item: str, most: int | None = None) -> Callable:
    """Scores segments of items: by sums of whole numbers for the queries that are small whole multiples of one number, as counts of words are, if no value is negative; others by groups of 128 in single precision. Both find candidates, which are scored again exactly.

    The k-th best of some items is a bar for all others; it rises as more are seen.
    """

    def run(batches):
        ids, matrix = shared.value
        single, norms, dim = matrix.astype(np.float32), np.sqrt((matrix * matrix).sum(axis=1)), matrix.shape[1]
        bars = np.full(len(ids), -np.inf)
        counted = _Counted(matrix) if keep_self else None
        for table in _segments(batches, most):
            items = _item(table, item)
            v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
            fine = np.isfinite(v).all(axis=1)
            if not fine.all():
                items, v = items.filter(pa.array(fine)), v[fine]
            longest, place, rows = np.sqrt(np.einsum("ij,ij->i", v, v).max(initial=0.0)), _places(items), []
            names = None if keep_self else items.to_numpy(zero_copy_only=False)
            others = np.arange(len(ids))
            if counted is not None and len(counted.queries) and v.min(initial=0.0) >= 0:
                rows, others = counted.best(v, longest, place, k, bars), counted.others
            turned = [np.ascontiguousarray(v[at : at + 2048].T, dtype=np.float32) for at in range(0, len(v), 2048)] if len(others) else []
            for lo in range(0, len(others), 128):
                who = others[lo : lo + 128]
                part, group = single[who], matrix[who]
                mine = None if names is None else np.array(ids[lo : lo + 128], dtype=object)
                slack = dim * 2.4e-7 * norms[who] * longest + 2e-9
                bar, kept, new = bars[who], np.zeros((3, 0)), []

                def settle(kept, new, bar):
                    """The k best of each query so far: query, item, score."""
                    q, c = (np.concatenate([x[i] for x in new]) for i in (0, 1))
                    s = np.einsum("ij,ij->i", group[q], v[c])
                    if mine is not None:
                        other = mine[q] != names[c]
                        q, c, s = q[other], c[other], s[other]
                    all_of = np.concatenate([kept, np.stack([q, c, s])], axis=1)
                    q, c, s = all_of[0].astype(np.int64), all_of[1].astype(np.int64), all_of[2]
                    order = np.lexsort((place[c], -np.round(s, 9), q))
                    q = q[order]
                    at = np.arange(len(q)) - np.searchsorted(q, q)
                    all_of = all_of[:, order[at < k]]
                    full = np.flatnonzero(at[at < k] == k - 1)
                    risen = all_of[0, full].astype(np.int64)
                    bar[risen] = np.maximum(bar[risen], all_of[2, full])
                    return all_of

                waiting, limit = 0, 64 * k * len(part)
                for i, block in enumerate(turned):
                    scores = part @ block
                    least = bar - slack
                    if mine is None and scores.shape[1] > k and not np.isfinite(least).all():
                        least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - 2 * slack)
                    hit = np.flatnonzero(scores >= least[:, None].astype(np.float32))
                    if len(hit):
                        new.append((hit // scores.shape[1], hit % scores.shape[1] + i * 2048))
                        waiting += len(hit)
                    if new and (waiting > limit or i in (0, 3, 15) or i == len(turned) - 1):
                        kept, new, waiting = settle(kept, new, bar), [], 0
                bars[who] = bar
                if kept.shape[1]:
                    q = kept[0].astype(np.int64)
                    cuts = np.flatnonzero(np.diff(q)) + 1
                    rows += [(int(who[a[0]]), c, s) for a, c, s in zip(np.split(q, cuts), np.split(kept[1].astype(np.int64), cuts), np.split(kept[2], cuts))]
            yield from _given(ids, None, rows, items)

    return run


def rrf(dense: DataFrame, lexical: DataFrame, k: int = 20, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: ties go to the better dense rank, then to the better lexical one."""
    both = (
        dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
        .join(lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank")), ["query_id", "chunk_id"], "full")
        .withColumn("score", F.coalesce(1 / (constant + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1 / (constant + F.col("lexical_rank")), F.lit(0.0)))
    )
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last())
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def minmax(score: str, w) -> Column:
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-9, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low))


def weighted(dense: DataFrame, lexical: DataFrame, k: int = 20, alpha: float = 0.5) -> DataFrame:
    """Fusion of scores scaled to 0..1 within each question and arm; an arm without the passage adds 0."""
    w = Window.partitionBy("query_id")
    d = dense.select("query_id", "chunk_id", minmax("score", w).alias("ds"))
    s = lexical.select("query_id", "chunk_id", minmax("score", w).alias("ls"))
    both = d.join(s, ["query_id", "chunk_id"], "full").withColumn("score", alpha * F.coalesce("ds", F.lit(0.0)) + (1 - alpha) * F.coalesce("ls", F.lit(0.0)))
    return top_k(both, k)


STRATEGIES = ("vector", "bm25", "hybrid", "hybrid_rrf", "hybrid_weighted")


def retrieve(strategy: str, dense: Callable[[int], DataFrame], lexical: Callable[[int], DataFrame], k: int = 20, pool: int = 2, alpha: float = 0.5) -> DataFrame:
    """Hits of a strategy; each arm of a hybrid one fetches pool * k."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "vector":
        return dense(k)
    if strategy == "bm25":
        return lexical(k)
    if strategy == "hybrid_weighted":
        return weighted(dense(pool * k), lexical(pool * k), k, alpha)
    return rrf(dense(pool * k), lexical(pool * k), k)


def both_arms(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """(query_id, chunk_id, dense_rank, dense_score, lexical_rank, lexical_score): a row a question and passage of either arm, together by question."""
    name = {"dense": ("dense_rank", "dense_score"), "lexical": ("lexical_rank", "lexical_score")}
    own = lambda hits, arm: hits.select("query_id", "chunk_id", *(F.col(c).alias(n) for c, n in zip(("rank", "score"), name[arm])))
    either = own(dense, "dense").unionByName(own(lexical, "lexical"), allowMissingColumns=True).repartition("query_id")
    return either.groupBy("query_id", "chunk_id").agg(*(F.max(c).alias(c) for c in (*name["dense"], *name["lexical"])))


def places(both: DataFrame, k: int = 20, alpha: float = 0.5, constant: int = 60) -> DataFrame:
    """both_arms() with the places up to k in the lists of either arm, of rrf() and of weighted(): vector, bm25, hybrid, hybrid_weighted; null where a list has not got the passage."""
    w = Window.partitionBy("query_id")
    ranks = [F.coalesce(1 / (constant + F.col(f"{a}_rank")), F.lit(0.0)) for a in ("dense", "lexical")]
    scaled = [F.when(F.col(f"{a}_score").isNotNull(), minmax(f"{a}_score", w)).otherwise(0.0) for a in ("dense", "lexical")]
    scored = both.withColumn("fused", ranks[0] + ranks[1]).withColumn("mixed", alpha * scaled[0] + (1 - alpha) * scaled[1])
    fused = F.row_number().over(w.orderBy(F.round("fused", 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last()))
    mixed = F.row_number().over(w.orderBy(F.round("mixed", 9).desc(), F.col("chunk_id")))
    lists = {"vector": F.col("dense_rank"), "bm25": F.col("lexical_rank"), "hybrid": fused, "hybrid_weighted": mixed}
    found = scored.select("query_id", "chunk_id", *(r.alias(n) for n, r in lists.items()))
    return found.select("query_id", "chunk_id", *(F.when(F.col(n) <= k, F.col(n)).alias(n) for n in lists))


def arm_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """By question: passages of the first arm only, of both, of the second only, and shared over united to three places. Rows move once, to their question."""
    own = lambda hits, x, y: hits.select("query_id", "chunk_id", F.lit(x).alias("x"), F.lit(y).alias("y"))
    each = own(a, 1, 0).unionByName(own(b, 0, 1)).repartition("query_id").groupBy("query_id", "chunk_id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    count = lambda c: F.sum(c).cast("int")
    x, y = F.col("x"), F.col("y")
    n = each.groupBy("query_id").agg(count(x * (1 - y)).alias("first_only"), count(x * y).alias("shared"), count(y * (1 - x)).alias("second_only"))
    united = F.col("first_only") + F.col("shared") + F.col("second_only")
    return n.withColumn("jaccard", F.round(F.col("shared") / F.greatest(united, F.lit(1)), 3))
