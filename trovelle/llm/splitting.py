"""Problem 4: oversized texts cut at natural boundaries by bounded-quantifier regular expressions.

One pattern consumes a text piece by piece. Its alternatives run from the strongest boundary to the
weakest; each takes as many tokens as fit and gives tokens back until the boundary stands behind it,
but never fewer than the overlap. The last alternative takes any token boundary, and a token of more than
LONGEST characters is no unit any more: it is taken by so many characters at a time, each part counting
against the limit, so that no piece outgrows limit * LONGEST characters. Other tokens are consumed whole with
the white space after them, so that pieces give the whole text and token counts add up.
The overlap is looked back for in the tokens of the piece before. All of it is SQL array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A token is a run of letters, digits and underscores of any script, or of other visible characters.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
_WORD = r"[\p{L}\p{N}_]"
_OTHER = r"[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]"
TOKEN = f"{_WORD}+|{_OTHER}+"
#: The most characters that are taken as one token when a text is cut.
LONGEST = 1000
_ATOM = f"(?:{_WORD}{{1,{LONGEST}}}+|{_OTHER}{{1,{LONGEST}}}+){_SPACE}*+"

# Boundaries behind a piece, the strongest first: paragraph, sentence, line, clause, word.
_BOUNDARIES = [
    r"(?<=\n[ \t\r]{0,20}\n\s{0,20})",
    r"(?<=[.!?…][\"')\]”’»]{0,3}\s{1,20})",
    r"(?<=\n\s{0,20})",
    r"(?<=[;:,)]\s{1,20})",
    r"(?<=\s)",
]


def token_count(text) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def piece_pattern(limit: int, overlap: int) -> str:
    """Consumes at most limit - overlap tokens: the rest of the text if it fits, else up to the strongest boundary."""
    most, least = limit - overlap, max(overlap, 1)
    ends = [f"(?:{_ATOM}){{1,{most}}}+(?!{_SPACE}*.)", *(f"(?:{_ATOM}){{{least},{most}}}{b}" for b in _BOUNDARIES), f"(?:{_ATOM}){{1,{most}}}"]
    return f"(?s){_SPACE}*+(?:" + "|".join(ends) + ")"


def split_texts(texts: DataFrame, keys: list[str], limit: int = 500, overlap: int = 75) -> DataFrame:
    """Pieces of the texts of more than `limit` tokens: keys and other columns, piece (from 0), n_pieces, text, token_count, char_start, char_end.

    The text is that of the column `text`; offsets count characters from 0, the end excluded, and take in
    the overlap. Null texts and those within the limit give no rows; of rows with the same keys the
    one with the greatest `stamp` counts (the greater text among equals). 0 <= overlap < limit / 2.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("the overlap must be less than half the limit")
    rest = [c for c in texts.columns if c not in (*keys, "text", "stamp")]
    large = texts.where((F.length("text") > limit) & (token_count(F.col("text")) > limit))
    one = large.groupBy(*keys).agg(F.max(F.struct("stamp", "text", *rest)).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in ("text", *rest)))
    cut = one.withColumn("segments", F.regexp_extract_all("text", F.lit(piece_pattern(limit, overlap)), F.lit(0)))
    cut = cut.select(*keys, *rest, F.size("segments").alias("n_pieces"), F.posexplode(_with_before()).alias("piece", "p"))
    tokens = F.regexp_extract_all("p.before", F.lit(_ATOM), F.lit(0))
    back = F.when((F.col("piece") > 0) & F.lit(overlap > 0), F.array_join(F.slice(tokens, -overlap, overlap) if overlap else F.array().cast("array<string>"), "")).otherwise("")
    cut = cut.withColumn("back", back)
    text = F.concat("back", "p.segment")
    start = F.col("p.start") - F.length("back")
    return cut.select(
        *keys,
        *rest,
        "piece",
        "n_pieces",
        text.alias("text"),
        token_count(text).alias("token_count"),
        start.cast("int").alias("char_start"),
        (F.col("p.start") + F.length("p.segment")).cast("int").alias("char_end"),
    )


def _with_before() -> Column:
    """Each segment with the one before it and the characters before it."""
    ends = F.aggregate(
        "segments",
        F.array(F.lit(0)),
        lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(s))),
    )
    return F.transform(
        F.arrays_zip(F.col("segments").alias("segment"), F.slice(ends, F.lit(1), F.size("segments")).alias("start"), F.sequence(F.lit(0), F.size("segments") - 1).alias("i")),
        lambda z: F.struct(
            z["segment"].alias("segment"),
            z["start"].alias("start"),
            F.when(z["i"] > 0, F.element_at("segments", F.greatest(z["i"], F.lit(1)))).otherwise("").alias("before"),
        ),
    )
