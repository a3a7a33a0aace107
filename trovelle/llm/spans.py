"""Problem 3: long exact spans shared between records, by hashing lines and grouping digests globally.

Units are lines: the words between two line feeds, normalised by their white space only (words count as
written). Digests of lines of at least `length` words are grouped over all records; a line with
occurrences of two owners is shared, its earliest ranked occurrence is the original, and the others are
repeats, all of whose words are covered and which the removal takes out. A shared stretch need not be a
whole line, so what remains is hashed in moving lines of `length` words that start at every word, and
these are grouped the same way; of a repeated line only the original takes part in that. Offsets of the
original words are kept throughout, so that shared units come out as runs of words.

An occurrence ranks by the time of its record (`rank`), then by `tie` (the first 60 bits of the MD5 of
kind and ref, so that equal times are settled alike everywhere), then by its place in the record.

Sending a digest for every moving line would move several times the text, so these are represented first
by the smallest hash of the short grams in them (a minimizer): equal lines have equal minimizers,
neighbouring ones mostly share theirs, so about a quarter of the digests remain. Only moving lines whose
minimizer occurs with two owners send their full digest. All steps are exact up to collisions of 64-bit
hashes: no shared unit is lost, none is reported that is not.

Scale. Records are spread over pages by the hash of their key; a page is a few megabytes whatever the
input, and is what a task holds at a time. A page sends one row a digest (its owners' range and its
earliest occurrence), so a stretch that every record shares costs one row a page; these are folded in a
stream, not held. Pages are shuffled once and read three times.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelle.functions import npkern as K
from trovelle.session import pages_for, partitions

GRAM = 8
_LINE_SPACE = np.uint64(0x5851F42D4C957F2D)  # digests of lines and of moving lines are kept apart
_ANY_OWNER = np.uint64((1 << 63) - 1)


def records(df: DataFrame, kind: str, ref: str, text: str, owner: str | None = None, rank: str | None = None) -> DataFrame:
    """(kind, ref, owner, rank, text). Rows without key or text are left out; owner defaults to the record itself."""
    return df.select(
        F.lit(kind).alias("kind"),
        F.col(ref).cast("string").alias("ref"),
        (F.coalesce(F.col(owner).cast("string"), F.concat(F.lit(kind + ":"), ref)) if owner else F.concat(F.lit(kind + ":"), ref)).alias("owner"),
        (F.coalesce(F.unix_micros(rank), F.lit(0)) if rank else F.lit(0)).cast("long").alias("rank"),
        F.col(text).cast("string").alias("text"),
    ).where("ref is not null and text is not null")


def thin(recs: DataFrame, remembered: int = 200_000) -> DataFrame:
    """Leaves out rows that a task has already sent a later or equal row of the same key for.

    Repeated rows of one key meet in one page; with this a key that a third of all rows repeat sends a few
    rows a task. Which row counts in the end is settled in the page.
    """

    def run(batches):
        best: dict[int, tuple[int, int]] = {}
        for batch in batches:
            key = (K.text_hashes(batch.column(1)) ^ (K.text_hashes(batch.column(0)) * np.uint64(3))).tolist()
            text, rank = K.text_hashes(batch.column(4)).tolist(), batch.column(3).to_pylist()
            keep = np.ones(len(batch), bool)
            for i, k in enumerate(key):
                old = best.get(k)
                if old is not None and (rank[i] < old[0] or (rank[i], text[i]) == old):
                    keep[i] = False
                elif old is not None or len(best) < remembered:
                    best[k] = (rank[i], text[i])
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return recs.mapInArrow(run, recs.schema)


@dataclass
class _Occurrences:
    """Occurrences of units in the order of their ranks: digest, the range of their owners, the record and the word they start at."""

    digest: np.ndarray
    least: np.ndarray
    most: np.ndarray
    rec: np.ndarray
    at: np.ndarray


class _Page:
    """The records of a page by rank, each key once (its latest row, the greater text among equals), and their units."""

    def __init__(self, table: pa.Table, length: int):
        table = table.combine_chunks()
        table = table.take(pc.sort_indices(table, [("kind", "ascending"), ("ref", "ascending"), ("rank", "descending"), ("text", "descending")]))
        keys = K.text_hashes(table["ref"]) ^ (K.text_hashes(table["kind"]) * np.uint64(3))
        keep = np.ones(len(keys), bool)
        keep[1:] = keys[1:] != keys[:-1]
        table = table.filter(pa.array(keep)).combine_chunks()
        self.table = table = table.take(pc.sort_indices(table, [("rank", "ascending"), ("tie", "ascending")])).combine_chunks()
        self.owner = K.text_hashes(table["owner"]) >> np.uint64(1)
        self.rank, self.tie = table["rank"].to_numpy(), table["tie"].to_numpy()
        data, offsets = K.byte_buffers(table["text"])
        self.offsets = offsets
        self.words = K.Words(data, offsets, K.BLANK)
        self.hash = self.words.hashes()
        self.length = length
        self.at, self.rec = K.expand_ranges(self.words.lo, self.words.hi - self.words.lo - length + 1)
        n = len(self.words)
        self.record = np.repeat(np.arange(len(self.words.lo)), self.words.hi - self.words.lo)
        line = np.searchsorted(np.flatnonzero(data == 10), self.words.start)
        fresh = np.ones(n, bool)
        fresh[1:] = (line[1:] != line[:-1]) | (self.record[1:] != self.record[:-1])
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], n)[: len(start)]
        some = end - start >= length
        self.line_start, self.line_end = start[some], end[some]

    def lines(self) -> _Occurrences:
        rec = self.record[self.line_start]
        return _Occurrences(K.runs_of(self.hash, self.line_start, self.line_end) ^ _LINE_SPACE, self.owner[rec], self.owner[rec], rec, self.line_start)

    def minimizers(self) -> np.ndarray:
        short = min(GRAM, self.length)
        m = K.sliding_min(K.grams(self.hash, short), self.length - short + 1)
        return m[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def units(self) -> np.ndarray:
        return K.grams(self.hash, self.length)[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def inside(self, some: np.ndarray) -> np.ndarray:
        """For each moving line: does it lie within one of those lines."""
        n = len(self.words) + 1
        step = np.bincount(self.line_start[some], minlength=n) - np.bincount(self.line_end[some] - self.length + 1, minlength=n)
        return (np.cumsum(step) > 0)[self.at]

    def covered(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each word: does it lie in one of the ranges."""
        n = len(self.words) + 1
        return (np.cumsum(np.bincount(start, minlength=n) - np.bincount(end, minlength=n)) > 0)[:-1]

    def is_original(self, o: _Occurrences, hit: np.ndarray, found: "_Found", where: np.ndarray) -> np.ndarray:
        """Of the occurrences with `hit`, whose digest stands at `where` in found: is it the earliest of all."""
        out = np.zeros(len(o.rec), bool)
        r, w = o.rec[hit], where[hit]
        out[hit] = (self.rank[r] == found.rank[w]) & (self.tie[r] == found.tie[w]) & (o.at[hit] - self.words.lo[r] == found.at[w])
        return out

    def runs(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of each longest run of flagged words within a record."""
        new = np.ones(len(flags), bool)
        new[1:] = self.record[1:] != self.record[:-1]
        before, after = np.concatenate([[False], flags[:-1]]), np.concatenate([flags[1:], [False]])
        last = np.concatenate([new[1:], [True]]) if len(flags) else new
        return np.flatnonzero(flags & (new | ~before)), np.flatnonzero(flags & (last | ~after))


class _Found:
    """The shared digests that a page holds, with their earliest occurrence."""

    def __init__(self, table: pa.Table):
        digest = table["digest"].to_numpy().view(np.uint64)
        order = np.argsort(digest)
        self.digest = digest[order]
        self.rank, self.tie, self.at = (pc.fill_null(table[c], -1).to_numpy()[order] for c in ("rank", "tie", "at"))

    def look(self, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Is each digest shared, and where it stands."""
        where = np.minimum(np.searchsorted(self.digest, digest), max(len(self.digest) - 1, 0))
        return (self.digest[where] == digest if len(self.digest) else np.zeros(len(digest), bool)), where


_DIGESTS = "page int, digest long, least long, most long, rank long, tie long, at long"


def _sent(number: int, page: _Page | None, o: _Occurrences | None, ranked: bool = True) -> pa.Table:
    """One row a digest: the range of its owners (`most` null if there is one), and its earliest occurrence if wanted."""
    names = [c.split(" ")[0] for c in _DIGESTS.split(", ")]
    if page is None or not len(o.digest):
        return pa.table({n: pa.array([], pa.int32() if n == "page" else pa.int64()) for n in names})
    order = np.argsort(o.digest, kind="stable")  # occurrences come by rank, so the first of a digest is its earliest
    d = o.digest[order]
    start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    first = order[start]
    rec = o.rec[first]
    least, most = np.minimum.reduceat(o.least[order], start), np.maximum.reduceat(o.most[order], start)
    columns = [pa.array(np.full(len(start), number, np.int32)), pa.array(d[start].view(np.int64)), pa.array(least.view(np.int64)), pa.array(most.view(np.int64), mask=least == most)]
    places = [pa.array(x.astype(np.int64)) for x in (page.rank[rec], page.tie[rec], o.at[first] - page.words.lo[rec])] if ranked else [pa.nulls(len(start), pa.int64())] * 3
    return pa.table([*columns, *places], names=names)


def _shared(digests: DataFrame, parts: int) -> DataFrame:
    """(page, digest, rank, tie, at): the digests of two owners in all, for each page that holds them, with their earliest occurrence.

    Digests are shuffled once: the fold over a digest and the way back to its pages read the same exchange.
    That takes both to read the same columns, hence a condition that names them and holds for every row.
    """
    by = digests.repartition(parts, "digest")
    first = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "tie", "at"))).alias("first")
    one = by.groupBy("digest").agg(F.min("least").alias("lo"), F.max(F.coalesce("most", "least")).alias("hi"), F.min("page").alias("p"), first).where("lo <> hi")
    holds = F.coalesce((F.col("least") >= F.col("lo")) & (F.coalesce("most", "least") <= F.col("hi")) & (F.col("page") >= F.col("p")) & (F.struct("rank", "tie", "at") >= F.col("first")), F.lit(True))
    rows, one = by.alias("rows"), one.alias("one")
    return rows.join(one, (F.col("rows.digest") == F.col("one.digest")) & (holds | F.col("rank").isNull())).select("page", "rows.digest", "first.rank", "first.tie", "first.at")


def _paged(recs: DataFrame, page_mb: float) -> tuple[DataFrame, int]:
    """The records by page, and in how many partitions: a page each up to 20,000 (or the session's own number), beyond that several."""
    n_pages = pages_for(recs, ["text"], page_mb)
    page = F.pmod(F.xxhash64("kind", "ref"), F.lit(n_pages)).cast("int")
    tie = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "ref")), 1, 15), 16, 10).cast("long")
    parts = max(partitions(recs.sparkSession), min(n_pages, 20_000))
    return thin(recs).withColumn("page", page).withColumn("tie", tie).select("page", "kind", "ref", "owner", "rank", "tie", "text").repartition(parts, "page"), parts


def _found(paged: DataFrame, parts: int, length: int, ranked: bool) -> DataFrame:
    """(page, digest, rank, tie, at): the shared lines and moving lines of each page; the ranks of moving lines only if wanted."""

    def first_step(table: pa.Table) -> pa.Table:
        page, number = _Page(table, length), table["page"][0].as_py()
        owner = page.owner[page.rec]
        moving = _Occurrences(page.minimizers(), owner, owner, page.rec, page.at)
        return pa.concat_tables([_sent(number, page, page.lines()), _sent(number, page, moving, False)])

    def second_step(table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(found) or not len(table):
            return _sent(0, None, None)
        page, number, known = _Page(table, length), table["page"][0].as_py(), _Found(found)
        lines = page.lines()
        shared, where = known.look(lines.digest)
        original = page.is_original(lines, shared, known, where)
        # of a shared line the original alone goes on, for all the owners of the line
        send = known.look(page.minimizers())[0] & ~page.inside(shared & ~original)
        every = page.inside(original)[send]
        owner = page.owner[page.rec[send]]
        moving = _Occurrences(page.units()[send], np.where(every, np.uint64(0), owner), np.where(every, _ANY_OWNER, owner), page.rec[send], page.at[send])
        # shared lines go along, that the last step may have them: with the place of their original
        at = np.unique(where[shared])
        line = pa.table([pa.array(x) for x in (np.full(len(at), number, np.int32), known.digest[at].view(np.int64), np.zeros(len(at), np.int64), np.full(len(at), _ANY_OWNER).view(np.int64), known.rank[at], known.tie[at], known.at[at])], names=[c.split(" ")[0] for c in _DIGESTS.split(", ")])
        return pa.concat_tables([line, _sent(number, page, moving, ranked)])

    once = paged.groupBy("page").applyInArrow(first_step, _DIGESTS)
    again = paged.groupBy("page").cogroup(_shared(once, parts).groupBy("page")).applyInArrow(second_step, _DIGESTS)
    return _shared(again, parts)


class _Covered:
    """The words of a page that lie in shared units (`covered`), and those that only repeat an original (`repeated`)."""

    def __init__(self, table: pa.Table, found: pa.Table, length: int):
        self.page = page = _Page(table, length)
        known, lines = _Found(found), page.lines()
        shared, where = known.look(lines.digest)
        original = page.is_original(lines, shared, known, where)
        owner = page.owner[page.rec]
        moving = _Occurrences(page.units(), owner, owner, page.rec, page.at)
        hit, at = known.look(moving.digest)
        first = page.is_original(moving, hit, known, at)
        repeat = shared & ~original
        hit &= ~page.inside(repeat)
        first &= hit
        line_covered = page.covered(page.line_start[shared], page.line_end[shared])
        span = lambda flags: page.covered(page.at[flags], page.at[flags] + length)
        self.covered = line_covered | span(hit)
        # a word that is in an original as well stays
        self.repeated = (page.covered(page.line_start[repeat], page.line_end[repeat]) | span(hit & ~first)) & ~span(first)

    def runs(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.page.runs(flags)


def shared_runs(recs: DataFrame, length: int = 14, page_mb: float = 2.0) -> DataFrame:
    """(kind, ref, n_words, first_word, last_word): longest runs of covered words of each record.

    A word is covered if it lies in `length` successive words that also occur successively in a record
    of another owner; positions count from 0, both ends included. Records shorter than `length` have no
    runs, nor have empty or null texts; repeated rows of a key count once (the latest, of equal times the
    one with the greater text). Records without runs give one row with null positions, so that shares can be
    taken over all of them. Other columns play no part.
    """
    paged, parts = _paged(recs, page_mb)

    def third_step(table: pa.Table, found: pa.Table) -> pa.Table:
        names = ["kind", "ref", "n_words", "first_word", "last_word"]
        if not len(table):
            return pa.table({n: pa.array([], pa.string() if n in ("kind", "ref") else pa.int64()) for n in names})
        c = _Covered(table, found, length)
        page = c.page
        start, end = c.runs(c.covered)
        r = page.record[start]
        bare = np.setdiff1d(np.arange(len(page.words.lo)), r)
        row = np.concatenate([r, bare])
        gone = pa.array(np.concatenate([np.zeros(len(r), bool), np.ones(len(bare), bool)]))

        def column(x):
            full = pa.array(np.concatenate([x, np.zeros(len(bare), np.int64)]).astype(np.int64))
            return pc.if_else(gone, pa.scalar(None, pa.int64()), full)

        base = page.words.lo[r]
        return pa.table(
            {
                "kind": page.table["kind"].take(pa.array(row)),
                "ref": page.table["ref"].take(pa.array(row)),
                "n_words": pa.array((page.words.hi - page.words.lo)[row].astype(np.int64)),
                "first_word": column(start - base),
                "last_word": column(end - base),
            }
        )

    return (
        paged.groupBy("page")
        .cogroup(_found(paged, parts, length, False).groupBy("page"))
        .applyInArrow(third_step, "kind string, ref string, n_words long, first_word long, last_word long")
    )


def without_repeats(recs: DataFrame, length: int = 14, page_mb: float = 2.0) -> DataFrame:
    """(kind, ref, text, removed): each record without the words that only repeat an earlier ranked occurrence.

    A line of at least `length` words that two owners have is kept where it ranks earliest and taken out
    everywhere else, in the same record too; then the same is done with moving lines of `length` words in what
    remains. Words that lie in such an original stay. `removed` lists (first_word, last_word,
    first_byte, end_byte) of the stretches taken out, in the original text; what stands between words
    goes with the word before it. Repeated rows of a key count once; null texts are left out.
    """
    paged, parts = _paged(recs, page_mb)
    span = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64())])

    def third_step(table: pa.Table, found: pa.Table) -> pa.Table:
        schema = pa.schema([("kind", pa.string()), ("ref", pa.string()), ("text", pa.string()), ("removed", pa.list_(span))])
        if not len(table):
            return schema.empty_table()
        c = _Covered(table, found, length)
        words, texts, offsets = c.page.words, c.page.table["text"].to_pylist(), c.page.offsets
        gone: list[list[dict]] = [[] for _ in texts]
        for a, b in zip(*(x.tolist() for x in c.runs(c.repeated))):
            r = int(c.page.record[a])
            end = int(words.start[b + 1]) if b + 1 < words.hi[r] else int(offsets[r + 1])
            gone[r].append({"first_word": a - int(words.lo[r]), "last_word": b - int(words.lo[r]), "first_byte": int(words.start[a] - offsets[r]), "end_byte": end - int(offsets[r])})
        for r, own in enumerate(gone):
            if own:
                raw, at, parts = texts[r].encode(), 0, []
                for g in own:
                    parts.append(raw[at : g["first_byte"]])
                    at = g["end_byte"]
                texts[r] = (b"".join(parts) + raw[at:]).decode()
        return pa.Table.from_arrays([c.page.table["kind"], c.page.table["ref"], pa.array(texts, pa.string()), pa.array(gone, pa.list_(span))], schema=schema)

    return (
        paged.groupBy("page")
        .cogroup(_found(paged, parts, length, True).groupBy("page"))
        .applyInArrow(third_step, "kind string, ref string, text string, removed array<struct<first_word:long,last_word:long,first_byte:long,end_byte:long>>")
    )


def shared_shares(runs: DataFrame) -> DataFrame:
    """(kind, ref, n_words, covered_words, share): one row a record."""
    size = F.coalesce(F.col("last_word") - F.col("first_word") + 1, F.lit(0))
    total = runs.groupBy("kind", "ref").agg(F.max("n_words").alias("n_words"), F.sum(size).alias("covered_words"))
    return total.withColumn("share", F.when(F.col("n_words") > 0, F.col("covered_words") / F.col("n_words")).otherwise(F.lit(0.0)))
