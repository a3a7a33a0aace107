"""Languages of texts by profiles of character trigrams that are learnt from the texts themselves.

A few common words of each language label the texts that hold them and hardly any of another; the
trigrams of those texts are counted into a first set of profiles; these label all texts, and the
trigrams of all texts that they label clearly make the final profiles. Counting covers every text; a profile has a
fixed number of buckets, so that the counts that reach the driver are bounded whatever the input.
A text's score is the sum over its words, each word's difference between languages being limited, so
that long names (the same in every language) do not outvote the words around them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelle.functions import npkern as K

# Common words that tell a language, all of them unlikely in the others.
WORDS = {
    "en": "the of and was were with for that by at be should is are not which from after when what how does in on has had than this may to a an no why who must more often",
    "de": "der die das und in von bei zu mit eine wurde auf nach für unter nicht ist den dem sollte werden wann welche welcher waren wird zur oder hat nur wenige jedoch dieser einer",
    "fr": "le la les de des et en par chez pour est dans sous après été du doit une un quelle quelles quels quel quand sont aux il ne pas ce cette avec être cas faut en d l a",
    "es": "el la los las de y en con por para se es del al fue debe más una un qué cuándo son tiene cuál cuáles no sobre caso su",
    "it": "il la gli le e di in un del della dei sono stati nei con per è deve una dopo stato più che pochi non nel caso come",
}
NAMES = list(WORDS)
BUCKETS = 1 << 15
#: The most that one word can tell two languages apart (natural logarithm), and the least difference for a clear label.
WORD_LIMIT = 9.0
CLEAR = 5.0


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points, a blank for every one that is no letter, a blank on either side of each text; and offsets."""
    padded = pa.array([f" {t or ''} " for t in column.to_pylist()], pa.string())
    points, offsets = K.code_points(padded)
    points = K.lower_table()[points]
    keep = K.unicode_class("word")[points] & ~((points >= 48) & (points <= 57)) & (points != 95)
    return np.where(keep, points, np.uint32(32)), offsets


class Grams:
    """The trigrams around each letter of a batch of texts: bucket and word; and of each word its text."""

    def __init__(self, column: pa.Array):
        points, offsets = _letters(column)
        p = points.astype(np.uint64)
        h = K.mix((p[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (p[2:] * np.uint64(0x165667B19E3779F9)))
        inner = p[1:-1] != 32
        begins = inner & (p[:-2] == 32)
        ends = inner & (p[2:] == 32)
        text = np.repeat(np.arange(len(column)), np.diff(offsets))[1:-1]
        self.bucket = (h[inner] % np.uint64(BUCKETS)).astype(np.int64)
        self.word = (np.cumsum(begins) - 1)[inner]
        self.text = text[begins]
        self.words = K.hash_ranges(points, np.flatnonzero(begins) + 1, np.flatnonzero(ends) + 2)
        self.n = len(column)

    def hits(self) -> np.ndarray:
        """How many common words of each language each text has."""
        return np.stack([np.bincount(self.text[np.isin(self.words, w)], minlength=self.n) for w in _common()], axis=1)

    def scores(self, profile: np.ndarray) -> np.ndarray:
        word = np.stack([np.bincount(self.word, p[self.bucket], minlength=len(self.text)) for p in profile], axis=1)
        word = np.maximum(word - word.max(axis=1, keepdims=True), -WORD_LIMIT) if len(word) else word
        return np.stack([np.bincount(self.text, word[:, j], minlength=self.n) for j in range(len(profile))], axis=1)

    def counts(self, label: np.ndarray) -> np.ndarray:
        """Trigrams of the texts with a label (-1: none), by language and bucket."""
        of = label[self.text[self.word]]
        some = of >= 0
        return np.bincount(of[some] * BUCKETS + self.bucket[some], minlength=len(NAMES) * BUCKETS)


_COMMON: list[np.ndarray] = []


def _common() -> list[np.ndarray]:
    if not _COMMON:
        for words in WORDS.values():
            points, offsets = K.code_points(pa.array(sorted(set(words.split()))))
            _COMMON.append(K.hash_ranges(points, offsets[:-1], offsets[1:]))
    return _COMMON


def seeded(hits: np.ndarray) -> np.ndarray:
    """The language of each text with two common words at least and more than twice those of any other language, else -1."""
    order = np.sort(hits, axis=1)
    return np.where((order[:, -1] >= 2) & (order[:, -1] > 2 * order[:, -2]), hits.argmax(axis=1), -1)


def labelled(scores: np.ndarray, least: float | np.ndarray) -> np.ndarray:
    order = np.sort(scores, axis=1)
    return np.where(order[:, -1] - order[:, -2] >= least, scores.argmax(axis=1), -1)


def profile_of(counts: np.ndarray) -> np.ndarray:
    """Logarithms of shares; what a language never has weighs alike in all, so that noise speaks for none."""
    counts = counts.reshape(len(NAMES), BUCKETS).astype(float)
    return np.log(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) + 1e-5).astype(np.float32)


def _counted(texts: DataFrame, label: Callable[[Grams], np.ndarray]) -> np.ndarray:
    def run(batches):
        total = np.zeros(len(NAMES) * BUCKETS, np.int64)
        for batch in batches:
            for column in batch.columns:
                g = Grams(column)
                total += g.counts(label(g))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most 5 * BUCKETS rows
    out = np.zeros(len(NAMES) * BUCKETS, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def learn(texts: DataFrame) -> np.ndarray:
    """Profiles (language, bucket) from all string columns of `texts`, which is read twice; null texts count as empty."""
    first = profile_of(_counted(texts, lambda g: seeded(g.hits())))
    return profile_of(_counted(texts, lambda g: labelled(g.scores(first), CLEAR)))


def languages(column: pa.Array, profile: np.ndarray) -> np.ndarray:
    """The language of each text as its place in NAMES; -1 where no language leads by 2 and 0.8 a word (too short, or no language at all)."""
    g = Grams(column)
    return labelled(g.scores(profile), 2.0 + 0.8 * np.bincount(g.text, minlength=g.n)) if g.n else np.zeros(0, int)
