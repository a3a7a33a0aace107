"""Problem 2: text quality statistics from associative partial counts, merged through a tree.

Texts are cut at fixed offsets into pieces. A piece is counted by itself; its state carries what the
cuts may have broken: the word fragment at each edge and the last visible characters of the line at
each edge. Merging two neighbours adds their counts and settles the word and the line that the cut
between them split. Merging is associative, so the pieces of a huge text go up a tree, `FAN` states at
a time, and the counts do not depend on where the cuts fall. Ratios and verdicts are column
expressions over the final counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelle.functions import npkern as K

PIECE = 1 << 16
FAN = 64
#: Levels of the tree: FAN**3 pieces hold more than the longest string that Spark can.
LEVELS = 3

# Characters that end a line of prose, those that may close it after them, and those usual inside a word or number.
LINE_ENDS = ".!?:;…"
CLOSERS = "\"')]”’»"
INNER = "-'’./,()%:;&+–"

COUNTS = ["n_chars", "n_words", "n_word_chars", "n_common", "n_symbols", "n_digits", "n_odd", "n_lines", "n_ended"]
_STATE = [*COUNTS, "head", "tail", "whole", "first_line", "last_line", "broken"]
_SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", head string, tail string, whole boolean, first_line string, last_line string, broken boolean"


class Counter:
    """Counts over batches of texts or pieces; `common` is the bounded list of common words."""

    def __init__(self, common: list[str]):
        self.common = np.unique(_hashes([w for w in common if w]))

    def words(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: is its core (without outer punctuation) common, and is it odd, i.e. has symbols or digits among its letters."""
        word = K.unicode_class("word")[points]
        at = np.flatnonzero(word)
        if not len(at) or not len(start):
            return np.zeros(len(start), bool), np.zeros(len(start), bool)
        i, j = np.searchsorted(at, start), np.searchsorted(at, end) - 1
        some = i <= j
        s, e = at[np.minimum(i, len(at) - 1)], at[np.maximum(j, 0)] + 1
        s, e = np.where(some, s, start), np.where(some, e, start)
        common = np.zeros(len(start), bool)
        keep = np.flatnonzero(some)
        common[keep] = np.isin(K.hash_ranges(K.lower_table()[points], s[keep], e[keep]), self.common)
        digit = (points >= 48) & (points <= 57)
        letter = word & ~digit
        usual = np.isin(points, np.array([ord(c) for c in INNER], points.dtype))
        bad = np.zeros(len(points) + 1, np.int64)
        bad[1:] = ~word & ~usual & ~K.unicode_class("space")[points]
        bad[1:-1] |= (letter[:-1] & digit[1:]) | (digit[:-1] & letter[1:])
        total = np.cumsum(bad)
        return common, (total[np.maximum(e - 1, s)] - total[s] > 0) & some

    def batch(self, column: pa.Array, cut_before: np.ndarray, cut_after: np.ndarray) -> dict[str, np.ndarray | list]:
        """The states of pieces; cut_before and cut_after tell which of their edges are cuts."""
        points, offsets = K.code_points(column)
        n = len(column)
        words = K.Words(points, offsets, K.unicode_class("visible"))
        lo, hi = words.lo, words.hi
        common, odd = self.words(points, words.start, words.end)
        size = words.end - words.start
        has = hi > lo
        at_first, at_last = np.where(has, words.start[np.minimum(lo, len(words) - 1)] if len(words) else 0, -1), np.where(has, words.end[np.maximum(hi - 1, 0)] if len(words) else 0, -1)
        head_cut = cut_before & has & (at_first == offsets[:-1])
        tail_cut = cut_after & has & (at_last == offsets[1:])
        alive = np.ones(len(words), bool)
        alive[lo[head_cut]] = False
        alive[hi[tail_cut] - 1] = False
        owner = np.repeat(np.arange(n), hi - lo)

        def summed(x):
            return np.bincount(owner[alive], x[alive].astype(float), minlength=n).astype(np.int64)

        out: dict = {"n_chars": np.diff(offsets), "n_words": summed(np.ones(len(words))), "n_word_chars": summed(size), "n_common": summed(common), "n_odd": summed(odd)}

        def per_text(flags):
            total = np.concatenate([[0], np.cumsum(flags)])
            return total[offsets[1:]] - total[offsets[:-1]]

        small = K.unicode_class("word")[points]
        out["n_symbols"] = per_text((~small & K.unicode_class("visible")[points]) | (points == 95))
        out["n_digits"] = per_text((points >= 48) & (points <= 57))
        lines, ended, states = np.zeros(n, np.int64), np.zeros(n, np.int64), {}
        breaks = np.flatnonzero(points == 10)
        line_start = np.union1d(offsets[:-1], breaks + 1)
        line_start = line_start[line_start < len(points)]
        line_end = np.concatenate([line_start[1:], [len(points)]])[: len(line_start)]
        at = np.flatnonzero(K.unicode_class("visible")[points])
        last = np.searchsorted(at, line_end) - 1
        seen = last >= np.searchsorted(at, line_start)
        text = np.searchsorted(offsets, line_start, side="right") - 1
        c1 = points[at[np.maximum(last, 0)]] if len(at) else np.zeros(len(last), np.uint32)
        c2 = points[at[np.maximum(last - 1, 0)]] if len(at) else c1
        c2 = np.where(last - 1 >= np.searchsorted(at, line_start), c2, 0)
        ends, closes = np.array([ord(c) for c in LINE_ENDS]), np.array([ord(c) for c in CLOSERS])
        good = np.isin(c1, ends) | (np.isin(c1, closes) & np.isin(c2, ends))
        first_of = line_start == offsets[:-1][text]
        last_of = (line_end == offsets[1:][text]) & (points[np.maximum(line_end - 1, 0)] != 10) if len(points) else np.zeros(len(line_end), bool)
        whole_line = ~((first_of & cut_before[text]) | (last_of & cut_after[text]))
        np.add.at(lines, text[seen & whole_line], 1)
        np.add.at(ended, text[seen & whole_line & good], 1)
        out["n_lines"], out["n_ended"] = lines, ended
        for c, empty in (("head", ""), ("tail", ""), ("first_line", ""), ("last_line", ""), ("whole", False), ("broken", False)):
            states[c] = [empty] * n
        for i in np.flatnonzero(cut_before | cut_after):
            s = column[int(i)].as_py() or ""
            states["broken"][i] = "\n" in s
            states["first_line"][i] = _last_two(s.split("\n", 1)[0]) if cut_before[i] or "\n" not in s else ""
            states["last_line"][i] = _last_two(s.rsplit("\n", 1)[-1]) if cut_after[i] and "\n" in s else ""
            one = head_cut[i] and tail_cut[i] and hi[i] - lo[i] == 1
            states["whole"][i] = bool(one) or not s
            states["head"][i] = s.split(None, 1)[0] if head_cut[i] else ""
            states["tail"][i] = s.rsplit(None, 1)[-1] if tail_cut[i] and not one else ""
        return out | states

    def one_word(self, w: str, out: dict) -> None:
        points, offsets = K.code_points(pa.array([w]))
        common, odd = self.words(points, offsets[:-1], offsets[1:])
        out["n_words"] += 1
        out["n_word_chars"] += len(w)
        out["n_common"] += int(common[0])
        out["n_odd"] += int(odd[0])

    def merge(self, a: dict, b: dict) -> dict:
        """The state of two neighbouring pieces together."""
        out = {c: a[c] + b[c] for c in COUNTS}
        whole = a["whole"] and b["whole"]
        if a["whole"]:
            head, tail = a["head"] + b["head"], "" if whole else b["tail"]
        elif b["whole"]:
            head, tail = a["head"], a["tail"] + b["head"]
        else:
            head, tail = a["head"], b["tail"]
            if a["tail"] + b["head"]:
                self.one_word(a["tail"] + b["head"], out)
        if a["broken"] and b["broken"]:
            _line(a["last_line"] + b["first_line"], out)
            first, last = a["first_line"], b["last_line"]
        elif a["broken"]:
            first, last = a["first_line"], (a["last_line"] + b["first_line"])[-2:]
        else:
            first, last = (a["first_line"] + b["first_line"])[-2:], b["last_line"]
        return out | {"head": head, "tail": tail, "whole": whole, "first_line": first, "last_line": last, "broken": a["broken"] or b["broken"]}

    def close(self, a: dict) -> dict:
        """The counts of a text all of whose pieces are merged."""
        out = dict(a)
        for w in (a["head"], a["tail"]):
            if w:
                self.one_word(w, out)
        _line(a["first_line"], out)
        if a["broken"]:
            _line(a["last_line"], out)
        return out


def _hashes(words: list[str]) -> np.ndarray:
    points, offsets = K.code_points(pa.array([w.lower() for w in words], pa.string()))
    return K.hash_ranges(points, offsets[:-1], offsets[1:])


def _last_two(s: str) -> str:
    return "".join(s.split())[-2:]


def _line(end: str, out: dict) -> None:
    if end:
        out["n_lines"] += 1
        out["n_ended"] += int(end[-1] in LINE_ENDS or (end[-1] in CLOSERS and len(end) > 1 and end[-2] in LINE_ENDS))


def text_counts(texts: DataFrame, keys: list[str], text: str, common: list[str], piece: int = PIECE) -> DataFrame:
    """keys and COUNTS, one row a row of texts (texts of more than a piece: one a different key); keys must be strings.

    A null text counts as an empty one.
    """
    schema = ", ".join(f"{k} string" for k in keys) + ", " + _SCHEMA
    narrow = texts.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text"))

    def table(batch, counted: dict) -> pa.RecordBatch:
        cols = [batch.column(k) for k in range(len(keys))]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array(counted[c]) for c in _STATE)], names=[*keys, *_STATE])

    def short(batches):
        counter = Counter(common)
        for batch in batches:
            none = np.zeros(len(batch), bool)
            yield table(batch, counter.batch(batch.column(len(keys)), none, none))

    def long_(batches):
        counter = Counter(common)
        for batch in batches:
            at = batch.column(len(keys) + 1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*table(batch, counter.batch(batch.column(len(keys)), at > 0, batch.column(len(keys) + 2).to_numpy(zero_copy_only=False) > at)).columns, batch.column(len(keys) + 1)], names=[*keys, *_STATE, "at"])

    def climb(last: bool):
        def step(group: pa.Table) -> pa.Table:
            counter, rows = Counter(common), sorted(group.to_pylist(), key=lambda r: r["at"])
            state = rows[0]
            for r in rows[1:]:
                state = counter.merge(state, r)
            state = (counter.close(state) if last else state) | {k: rows[0][k] for k in keys} | {"at": rows[0]["at"] // FAN}
            return pa.table({c: [state[c]] for c in [*keys, *_STATE, "at"]}, schema=group.schema.remove(group.schema.get_field_index("up")))

        return step

    few = narrow.where(F.length("text") <= piece).mapInArrow(short, schema)
    cuts = narrow.where(F.length("text") > piece).groupBy(*keys).agg(F.max("text").alias("text")).withColumn("n", F.expr(f"cast((length(text) - 1) div {piece} as int)"))
    cuts = cuts.select(*keys, "text", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("at"))
    cuts = cuts.select(*keys, F.expr(f"substring(text, at * {piece} + 1, {piece})").alias("text"), F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"))
    state = cuts.mapInArrow(long_, schema + ", at long")
    for level in range(LEVELS):
        state = state.withColumn("up", F.expr(f"at div {FAN}")).groupBy(*keys, "up").applyInArrow(climb(level == LEVELS - 1), schema + ", at long")
    return few.select(*keys, *COUNTS).unionByName(state.select(*keys, *COUNTS))


def verdict() -> Column:
    """Whether a text is prose, by its counts; texts under 40 characters are taken as prose.

    Sentences hold a steady share of common words (in this corpus 0.20 to 0.38). Lists and tables have
    few, chance sequences of words too many without punctuation, damaged text many odd words. Between
    clear lists and clear sentences, long lines with few symbols are taken as sentences.
    """
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "n_chars"))
    common, odd, symbols = F.col("n_common") / words, F.col("n_odd") / words, F.col("n_symbols") / chars
    between = (common < 0.165) & ~((common >= 0.115) & (F.col("n_chars") / lines >= 130) & (symbols < 0.045))
    junk = between | (odd > 0.3) | ((common > 0.42) & (symbols < 0.012)) | (symbols > 0.25)
    return (F.col("n_chars") < 40) | ~junk


def statistics(counts: DataFrame) -> DataFrame:
    """The counts with ratios (0 for texts without words or lines) and the verdict is_prose."""

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return counts.select(
        "*",
        ratio("n_word_chars", "n_words").alias("mean_word_length"),
        ratio("n_symbols", "n_chars").alias("symbol_share"),
        ratio("n_ended", "n_lines").alias("ended_line_share"),
        ratio("n_common", "n_words").alias("common_word_share"),
        ratio("n_odd", "n_words").alias("odd_word_share"),
        verdict().alias("is_prose"),
    )


_EPOCH = "timestamp'1970-01-01 00:00:00'"


def chunk_texts(chunks: DataFrame, *more: str) -> DataFrame:
    """(kind, ref, stamp, text, and more columns) of the chunks with a key; stamp orders the rows of a key."""
    stamp = F.lpad(F.unix_micros(F.coalesce("indexed_at", F.expr(_EPOCH))).cast("string"), 20, "0")
    return chunks.where("chunk_id is not null").select(F.lit("chunk").alias("kind"), F.col("chunk_id").cast("string").alias("ref"), stamp.alias("stamp"), F.coalesce("text", F.lit("")).alias("text"), *more)


def block_texts(documents: DataFrame, *more: str) -> DataFrame:
    """(kind, ref, stamp, text, and more fields) of the blocks of the documents with a key."""
    stamp = F.lpad(F.unix_micros(F.coalesce("ingested_at", F.expr(_EPOCH))).cast("string"), 20, "0")
    return documents.where("document_id is not null").select("document_id", stamp.alias("stamp"), F.posexplode("blocks").alias("pos", "block")).select(
        F.lit("block").alias("kind"), F.concat(F.col("document_id").cast("string"), F.lit("#"), F.col("pos").cast("string")).alias("ref"), "stamp", F.coalesce("block.text", F.lit("")).alias("text"), *(F.col(f"block.{c}").alias(c) for c in more)
    )


def latest_counts(texts: DataFrame, common: list[str]) -> DataFrame:
    """(kind, ref, COUNTS), one row a key: those of its latest row, the greater counts among equals."""
    counts = text_counts(texts, ["kind", "ref", "stamp"], "text", common)
    one = counts.groupBy("kind", "ref").agg(F.max(F.struct("stamp", *COUNTS)).alias("m"))
    return one.select("kind", "ref", *(F.col(f"m.{c}").alias(c) for c in COUNTS))
