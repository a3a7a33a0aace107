"""Problem 6: defects of prompt and response pairs.

Truncation is judged on three kinds of evidence, for every response. Responses are sorted by text, so that a
shortened version stands directly before a longer one that starts with it; it is broken off if the longer
one goes on within the sentence. Completion lengths are counted, and a length far more frequent than those
around it is a limit that responses ran into; a response at the limit is broken off unless it ends with
a stop or a citation. The ending tells the rest: an open bracket, a list marker, a comma or a word
that hardly ever ends a sentence in the corpus is broken off; a word that usually does is a missing
full stop unless other evidence says more. Empty, copied and refusing responses follow from rules in column
expressions, foreign ones from profiles of character trigrams (language.py).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelle.llm import language
from trovelle.session import stored

# What a response that answers nothing says, by language, and what may stand beside it.
REFUSALS = [
    r"(?:cannot|can['’]?t|can not|could not|couldn['’]?t|unable to|not able to|not possible to|unwilling to|will not|won['’]?t)\b[^.!?]{0,40}\b(?:answer(?:ed)?|be answered|(?:be )?f(?:ind|ound)|comment|say|tell|help|determine|assist|provide|respond)\b",
    r"\b(?:do|does|did) not (?:contain|address|include|cover|provide|mention|give|offer)\b[^.!?]{0,20}\b(?:information|this|that|it|details?|an answer|anything|the answer)\b",
    r"\b(?:not enough|insufficient|no sufficient|too little)\b[^.!?]{0,40}\b(?:evidence|information|context|to (?:say|answer|tell|judge))\b",
    r"\b(?:is|are) insufficient to\b",
    r"\bno (?:relevant|matching|suitable) (?:passage|excerpt|document|source|information|evidence)s?\b",
    r"\bno (?:answer|information) (?:can be|could be|is|was|to)\b",
    r"\bnothing (?:in|about|on)\b[^.!?]{0,60}\b(?:cover|address|answer|mention|say|found)",
    r"\bnone of the (?:sources|passages|documents|excerpts)\b[^.!?]{0,20}\b(?:mention|address|cover|answer|contain)",
    r"\b(?:is|are|remain) silent (?:on|about)\b",
    r"\b(?:would|['’]d) rather not\b",
    r"\bi (?:don['’]?t|do not) (?:know|have)\b",
    r"\b(?:deal|deals) with (?:other|different|another)\b",
    r"enthalten keine (?:angaben|informationen|hinweise)",
    r"(?:kann|können|lässt sich|konnte)\b[^.!?]{0,60}\bnicht (?:beantworte|gefunden|sagen|beantwortet)",
    r"keine (?:angaben|informationen|antwort)\b",
    r"(?:ne contien\w*|ne comport\w*|ne donn\w*) (?:aucune?|pas)",
    r"(?:ne peux pas|ne peut pas|impossible de|ne peut être)\b[^.!?]{0,30}\b(?:répond|trouv|dire)",
    r"aucune (?:information|réponse)",
    r"no (?:contienen|contiene|incluyen|ofrecen) (?:información|datos)",
    r"(?:no puedo|no se puede|no es posible|no se ha podido|no pude)\b[^.!?]{0,30}\b(?:respond|contest|encontr|decir)",
    r"(?:no hay|no se encontr\w*|ninguna) información",
    r"non (?:contengono|contiene) (?:informazioni|dati|alcuna)",
    r"(?:non posso|non è possibile|impossibile)\b[^.!?]{0,30}\b(?:rispond|trovar|dire)",
]
BESIDE = [
    r"\bi (?:have )?(?:looked|searched|checked|read|went) (?:through|over|in|all)?\b",
    r"\bplease (?:rephrase|try|ask|consult|contact|provide)\b",
    r"^(?:i['’]?m |i am |we are )?sorry\b",
    r"\b(?:unfortunately|regrettably)\W*$",
    r"\bbitte (?:formulieren|stellen)\b|\bveuillez\b|\bpor favor\b|\bper favore\b|\bes tut mir leid\b|\bdésolé|\blo siento\b|\bmi dispiace\b",
]

# One of these words is in every sentence that REFUSALS or BESIDE match; most sentences have none.
CUES = (
    r"\b(?:can|cannot|could|couldn|unable|not|won|no|nothing|none|silent|would|don|deals?|insufficient|sufficient|little|rather|keine|nicht|ne|aucune|impossible|impossibile|ninguna|"
    r"non|i|please|sorry|unfortunately|regrettably|bitte|leid|veuillez|por|per|désolé|siento|dispiace)\b|['’]d rather"
)

# Introductions that say nothing, and responses that are no words of their own.
LEADS = r"^(?:\W*(?:you asked|your question|the question (?:was|is)|question|answer|the answer is|antwort|frage|réponse|respuesta|pregunta|risposta)\s*[:：]\s*)+"
NOTHING = ["", "na", "null", "none", "nil", "nan", "answer", "noanswer", "tbd", "empty", "undefined", "antwort", "réponse", "respuesta", "risposta"]

CITES = r"(?:\s*\[\d{1,3}\])+"
_ABBREVIATIONS = r"(?:\b(?:vs|e\.g|i\.e|etc|approx|dr|mr|mrs|ms|prof|no|fig|cf|resp|z\.b|p\.ej)\.)$"


def _model(answers: DataFrame) -> Column:
    """The model of each answer; null where it is empty or the table has none."""
    return F.nullif(F.trim("model"), F.lit("")) if "model" in answers.columns else F.lit(None).cast("string")


def latest_answers(answers: DataFrame) -> DataFrame:
    """One row an answer_id: the one logged last, the greater answer among equals; rows without answer_id are left out."""
    order = F.struct(F.coalesce("logged_at", F.expr("timestamp'1970-01-01 00:00:00'")), F.coalesce("answer", F.lit("")))
    one = answers.where("answer_id is not null").groupBy("answer_id").agg(F.max_by(F.struct("question", "answer", F.col("usage.completion_tokens").alias("length"), _model(answers).alias("model")), order).alias("m"))
    return one.select("answer_id", F.coalesce("m.question", F.lit("")).alias("question"), F.coalesce("m.answer", F.lit("")).alias("answer"), F.col("m.length").alias("length"), F.col("m.model").alias("model"))


def bare(text: Column) -> Column:
    """Without citations, invisible characters, outer white space and introductions."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[\x{200b}-\x{200f}\x{feff}\x{2060}\x{ad}]++", ""), r"\[\d{1,3}\]", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"^[\s\p{Z}]+|(?<![\s\p{Z}])[\s\p{Z}]+$", ""), "(?iU)" + LEADS, "")


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def shortened(texts: DataFrame) -> DataFrame:
    """(h, rest): the texts after which, in sorted order, a longer text that starts with them comes next, and the first 40 characters it goes on with.

    `texts` has different texts in its column `text`, with their hash h. They are ranged over partitions by the
    text, and only the first and last text of each partition meet again, in a table of at most two rows a partition.
    """
    ranged = texts.select("text", "h").repartitionByRange("text").sortWithinPartitions("text")
    names = ["h", "rest", "part", "last", "first"]

    def neighbours(batches):
        from pyspark import TaskContext

        part, first, last, of = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            found = []
            for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = t if first is None else first
                if last is not None and t.startswith(last):
                    found.append((of, t[len(last) : len(last) + 40]))
                last, of = t, h
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([r for _, r in found], pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.nulls(1, pa.string()), pa.array([part], pa.int32()), pa.array([last]), pa.array([first])], names=names)

    seen = ranged.mapInArrow(neighbours, "h long, rest string, part int, last string, first string")
    edges = seen.where("part is not null").withColumn("next", F.lead("first").over(Window.orderBy("part"))).where(F.col("next").startswith(F.col("last")))
    return seen.where("part is null").select("h", "rest").union(edges.select("h", F.expr("substring(next, length(last) + 1, 40)").alias("rest")))


def length_spikes(answers: DataFrame, factor: float = 8.0, window: int = 20) -> DataFrame:
    """(model, length): completion lengths at least `factor` times as frequent as the lengths around them, the larger end of the scale only.

    Each model's answers (model, length) are looked at by themselves, and all together under a null model, which
    holds for every answer: so answers without a model and models of few answers have evidence too. A spike has
    four answers at least, for `factor` times half an answer. The histograms have one row a model and different
    length, which the model's context bounds.
    """
    each = answers.where("length > 0").select("length", F.explode(F.array_distinct(F.array(_model(answers), F.lit(None).cast("string")))).alias("model"))
    counts = each.groupBy("model", "length").agg(F.count(F.lit(1)).alias("n"))
    around = Window.partitionBy("model").orderBy("length").rangeBetween(-window, window)
    top = Window.partitionBy("model").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    marked = counts.withColumn("near", (F.sum("n").over(around) - F.col("n")) / (2 * window)).withColumn("above", F.coalesce(F.sum("n").over(top), F.lit(0)))
    return marked.where((F.col("n") >= factor * F.greatest("near", F.lit(0.5))) & (F.col("above") < F.col("n"))).select("model", "length")


def final_words(answers: DataFrame) -> DataFrame:
    """(word, final_rate, n): how often each word of the responses ends a sentence or a cited statement.

    A last word without a stop is in question itself and does not count.
    """
    text = F.lower(F.regexp_replace("answer", r"[\p{L}]+\)*\s*$", ""))
    words = answers.select(F.explode(F.regexp_extract_all(text, F.lit(r"[\p{L}]+(?:\)*(?:[.!?](?=\s|$)|\s*\[(?=\d{1,3}\])))?"), F.lit(0))).alias("w"))
    final = F.right("w", F.lit(1)).isin(".", "!", "?", "[")
    return words.groupBy(F.regexp_extract("w", r"^[\p{L}]+", 0).alias("word")).agg(F.avg(final.cast("double")).alias("final_rate"), F.count(F.lit(1)).alias("n"))


def is_refusal(text: Column) -> Column:
    """All sentences say that there is no answer, or stand beside such a one; a first sentence that does neither settles it."""
    sentences = F.filter(F.split(F.lower(text), r"(?<=[.!?;])\s+"), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    says = lambda s: s.rlike("|".join(REFUSALS))
    every = F.forall(sentences, lambda s: s.rlike(CUES) & (says(s) | s.rlike("|".join(BESIDE))))
    return every & F.exists(sentences, says)


_STOP = r"[.!?…。][\"')\]”’»*]*$"
#: A longer text that goes on so had the sentence complete: citations and a stop alone.
_ONLY_STOP = r"^\s*(?:\[\d{1,3}\]\s*)*[.!?…](?:\s|$|\[)"
_QUOTED = "[“„\"«][^”“\"»]{0,80}[”“\"»]"


def _with_languages(rows: DataFrame, profile: np.ndarray) -> DataFrame:
    """answer_id and whether the languages of `asked_text` and `said_text` are both known and differ."""

    def run(batches):
        for batch in batches:
            ours, theirs = (language.languages(batch.column(i), profile) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((ours >= 0) & (theirs >= 0) & (ours != theirs))], names=["answer_id", "language"])

    return rows.select("answer_id", "asked_text", "said_text").mapInArrow(run, "answer_id long, language boolean")


def pair_features(answers: DataFrame) -> DataFrame:
    """One row a row of latest_answers(): answer_id, h, model, length, the flags empty, copy, refusal, closed, broken, the last word where
    nothing closes the text (open_word), and the texts whose languages are compared."""
    a = answers.withColumn("said", bare(F.col("answer"))).withColumn("core", letters(F.col("said"))).withColumn("asked", letters(F.col("question")))
    rest = F.when(F.length("asked") > 0, F.replace(F.col("core"), F.col("asked"), F.lit(""))).otherwise(F.col("core"))
    a = a.withColumn("empty", F.col("core").isin(NOTHING))
    a = a.withColumn("copy", ~F.col("empty") & (F.length("asked") > 0) & (rest != F.col("core")) & rest.isin(NOTHING))
    a = a.withColumn("refusal", ~F.col("empty") & ~F.col("copy") & is_refusal(F.col("said")))
    end = F.regexp_replace(F.col("answer"), r"[\s\x{a0}\x{200b}\x{feff}]+$", "")
    a = a.withColumn("end", F.right(end, F.lit(60)))  # longer than all endings looked for
    cited = F.col("end").rlike(r"\[\d{1,3}\]$")
    stop = F.col("end").rlike(_STOP) & ~F.lower("end").rlike(_ABBREVIATIONS)
    marker = F.col("end").rlike(r"(?:^|\n)\s*(?:\d{1,3}[.)]|[-*•–]|\(\w\))$")
    opened = F.col("end").rlike(r"\[\d{0,3}$|[(,;:\-–„“«]$")
    a = a.withColumn("broken", ~F.col("empty") & (marker | (opened & ~cited)))
    a = a.withColumn("closed", (stop | cited) & ~F.col("broken"))
    word = F.coalesce(F.nullif(F.lower(F.regexp_extract("end", r"([\p{L}]+)[^\p{L}]*$", 1)), F.lit("")), F.lit("#"))
    a = a.withColumn("open_word", F.when(~F.col("empty") & ~F.col("broken") & ~F.col("closed"), word))
    skip = F.col("empty") | F.col("copy")
    return a.select(
        "answer_id", "h", "model", "length", "empty", "copy", "refusal", "broken", "closed", "open_word",
        F.when(~skip, F.col("question")).alias("asked_text"), F.when(~skip, F.regexp_replace("said", _QUOTED, " ")).alias("said_text"),
    )


def pair_evidence(answers: DataFrame, final_rate: float = 0.9) -> DataFrame:
    """(answer_id, evidence): everything that speaks for a defect of a pair.

    empty, copy, refusal and language are defects themselves; shortened (a longer response goes on within the
    sentence), limit (at a length limit and not closed), broken (ends in a list marker, open bracket or comma) and
    open_word (ends in a word that seldom ends a sentence) are evidence of truncation. Null and blank answers are
    empty and nothing else; a copy or refusal is not looked at for truncation. Null questions have no copies and no
    language. Rows of one answer_id count once, the one logged last.
    """
    one = stored(latest_answers(answers).withColumn("h", F.xxhash64("answer")))
    rows = stored(pair_features(one))
    foreign = _with_languages(rows, language.learn(rows.select("asked_text", "said_text"))).where("language").select("answer_id", F.lit("language").alias("evidence"))
    texts = one.where(F.length("answer") >= 8).select("h", F.col("answer").alias("text")).dropDuplicates(["h"])
    open_ = rows.where("not empty and not copy and not refusal")
    complete = F.col("rest").rlike(_ONLY_STOP) | (F.col("closed") & F.col("rest").rlike(r"^(?:\s|\[|$)"))
    short = open_.join(shortened(texts), "h").where(~complete).select("answer_id", F.lit("shortened").alias("evidence"))
    spikes = length_spikes(one).select(F.col("model").alias("of"), F.col("length").alias("limit"))
    at = (F.col("length") == F.col("limit")) & (F.col("of").isNull() | (F.col("of") == F.col("model")))
    limited = open_.where("open_word is not null or broken").join(spikes, at, "left_semi").select("answer_id", F.lit("limit").alias("evidence"))
    may_end = final_words(one).where((F.col("final_rate") >= final_rate) & (F.col("n") >= 3)).select(F.col("word").alias("open_word"))
    worded = open_.where("open_word is not null").join(may_end, "open_word", "left_anti").select("answer_id", F.lit("open_word").alias("evidence"))
    flags = F.array(*(F.when(F.col(c), F.lit(c)) for c in ("empty", "copy", "refusal")), F.when(F.col("broken") & ~F.col("copy") & ~F.col("refusal"), F.lit("broken")))
    rules = rows.select("answer_id", F.explode(F.array_compact(flags)).alias("evidence"))
    return rules.union(foreign).union(short).union(limited).union(worded)


def pair_defects(answers: DataFrame, final_rate: float = 0.9) -> DataFrame:
    """(answer_id, defect): every defect of each pair, of empty, truncated, refusal, copy, language; see pair_evidence()."""
    truncated = F.col("evidence").isin("shortened", "limit", "broken", "open_word")
    return pair_evidence(answers, final_rate).select("answer_id", F.when(truncated, F.lit("truncated")).otherwise(F.col("evidence")).alias("defect")).distinct()
