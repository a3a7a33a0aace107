"""Text columns: cleaning, words, sentences, tokens, snippets, query expansion. All of it stays in the JVM but NFKC."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The stopwords of the lexical index.
STOPWORDS = """
a an and are as at be been but by for from has have had he her his i if in into is it its
of on or our s she t that the their them then there these they this to was were what when
which who will with would you your
""".split()

# Abbreviations and what a query is expanded with.
ABBREVIATIONS = {
    "htn": "hypertension",
    "bp": "blood pressure",
    "mi": "myocardial infarction",
    "chf": "congestive heart failure",
    "hf": "heart failure",
    "hfref": "heart failure reduced ejection fraction",
    "cad": "coronary artery disease",
    "acs": "acute coronary syndrome",
    "af": "atrial fibrillation",
    "afib": "atrial fibrillation",
    "dvt": "deep vein thrombosis",
    "pe": "pulmonary embolism",
    "vte": "venous thromboembolism",
    "cva": "cerebrovascular accident stroke",
    "tia": "transient ischemic attack",
    "t2dm": "type 2 diabetes mellitus",
    "t1dm": "type 1 diabetes mellitus",
    "dm": "diabetes mellitus",
    "dka": "diabetic ketoacidosis",
    "hba1c": "hemoglobin a1c glycated hemoglobin",
    "ckd": "chronic kidney disease",
    "aki": "acute kidney injury",
    "esrd": "end stage renal disease",
    "egfr": "estimated glomerular filtration rate",
    "copd": "chronic obstructive pulmonary disease",
    "ards": "acute respiratory distress syndrome",
    "osa": "obstructive sleep apnea",
    "uti": "urinary tract infection",
    "cap": "community acquired pneumonia",
    "gerd": "gastroesophageal reflux disease",
    "ibd": "inflammatory bowel disease",
    "ra": "rheumatoid arthritis",
    "sle": "systemic lupus erythematosus",
    "mdd": "major depressive disorder",
    "gad": "generalized anxiety disorder",
    "ssri": "selective serotonin reuptake inhibitor",
    "snri": "serotonin norepinephrine reuptake inhibitor",
    "ace": "angiotensin converting enzyme",
    "acei": "angiotensin converting enzyme inhibitor",
    "arb": "angiotensin receptor blocker",
    "ccb": "calcium channel blocker",
    "nsaid": "nonsteroidal anti-inflammatory drug",
    "ppi": "proton pump inhibitor",
    "doac": "direct oral anticoagulant",
    "ldl": "low density lipoprotein cholesterol",
    "hdl": "high density lipoprotein cholesterol",
    "bmi": "body mass index",
    "icu": "intensive care unit",
    "ed": "emergency department",
    "iv": "intravenous",
    "po": "oral administration",
    "prn": "as needed",
    "bid": "twice daily",
    "tid": "three times daily",
    "qd": "once daily",
    "rct": "randomized controlled trial",
    "nnt": "number needed to treat",
    "ci": "confidence interval",
}

# Single characters that stand for several.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "…": "..."}

# Lines that are no content (at the start of a trimmed line, any case).
PAGE_NUMBER = r"^[\s]*(?:page\s*)?[-–—|]?\s*[0-9]{1,4}\s*[-–—|]?\s*$"
BOILERPLATE = [
    r"^this is an open[- ]access article distributed.*$",
    r"^creative commons attribution.*$",
    r"^all rights reserved\.?$",
    r"^downloaded from .*$",
    r"^for personal use only.*$",
    r"^see discussions, stats, and author profiles.*$",
    r"^the copyright holder for this preprint.*$",
    r"^\s*doi:\s*\S+\s*$",
    r"^\s*issn[: ].*$",
]

# Patterns of what cleaning takes out, and where sentences end.
WORD = r"[\p{L}\p{N}_]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
HYPHEN_WRAP = rf"({WORD})-\n({WORD})"
URL = r"https?://\S+"
EMAIL = rf"{WORD}[\p{{L}}\p{{N}}_.+-]*+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]*{WORD}"
CITATION = r"\[\s*[0-9]+(?:\s*[-–,]\s*[0-9]+)*\s*\]"
FIGURE = r"(?i)\((?:see\s+)?(?:fig(?:ure)?|table)\.?\s*[0-9]+[a-z]?\)"
EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_\s\p{{Z}}]"

_NO_WORD = r"(?<![\p{L}\p{N}_])"
#: A sentence ends after . ! ? before white space and a capital, digit or bracket, unless an abbreviation stands there.
SENTENCE = (
    r"(?<![A-Z][a-z]\.)"
    rf"(?<!{_NO_WORD}[A-Z]\.)"
    rf"(?<!{_NO_WORD}e\.g\.)(?<!{_NO_WORD}i\.e\.)(?<!{_NO_WORD}vs\.)(?<!{_NO_WORD}et\sal\.)"
    rf"(?<!{_NO_WORD}Fig\.)(?<!{_NO_WORD}No\.)(?<!{_NO_WORD}approx\.)"
    r"(?<=[.!?])[\s\p{Z}]+(?=[A-Z0-9(])"
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def fix_ligatures(text: Column) -> Column:
    for bad, good in LIGATURES.items():
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def normalize_whitespace(text: Column) -> Column:
    """Line ends to \\n, runs of blanks to one, three or more line ends to two, trimmed; clean_text() takes the compatibility form (nfkc()) first."""
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t\x{a0}]+", " "), r"\n{3,}", "\n\n"))


def keep_lines(text: Column) -> Column:
    """Trimmed lines but bare page numbers and boilerplate; blank lines stay, as paragraph marks."""
    drop = "|".join([PAGE_NUMBER, *BOILERPLATE])
    lines = F.transform(F.split(text, "\n", -1), strip)
    return F.array_join(F.filter(lines, lambda x: (x == "") | ~x.rlike("(?i)" + drop)), "\n")


def drop_references(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, CITATION, " "), FIGURE, " ")


def before_nfkc(text: Column, drop_citations: bool = True) -> Column:
    """The steps of clean_text() that come before the compatibility form."""
    text = fix_ligatures(F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, " "))
    text = F.regexp_replace(text, HYPHEN_WRAP, "$1$2")
    text = F.regexp_replace(F.regexp_replace(text, URL, " "), EMAIL, " ")
    return keep_lines(drop_references(text) if drop_citations else text)


def clean_text(text: Column, drop_citations: bool = True) -> Column:
    """Control characters, ligatures, wrapped words, links, addresses, references, lines, compatibility form, white space, in this order. Null gives the empty text."""
    return normalize_whitespace(nfkc(before_nfkc(text, drop_citations)))


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; Arrow batches, for Spark has no such function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return run(text)


def nfkc_each(texts: Column) -> Column:
    """The same for each text of an array."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda a: None if a is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in a])

    return run(texts)


def is_meaningful(text: Column, least_chars: int = 120, least_letters: float = 0.6, least_words: int = 20) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\s\p{Z}]", ""))
    return F.coalesce((F.length(text) >= least_chars) & (letters / F.greatest(F.length(text), F.lit(1)) >= least_letters) & (F.size(words(text)) >= least_words), F.lit(False))


def words(text: Column) -> Column:
    """Runs of characters that are no white space."""
    return F.regexp_extract_all(text, F.lit(r"[^\s\p{Z}]+"), F.lit(0))


def tokenize(text: Column, stopwords: bool = True) -> Column:
    """Lower-case words of a-z and 0-9, parts of hyphenated ones apart, without stopwords, repeats kept."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(tokens, lambda t: ~t.isin(STOPWORDS)) if stopwords else tokens


def count_tokens(text: Column) -> Column:
    """The default token counter: words and single symbols. Another one can be plugged in where a counter is asked for."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


def truncate_tokens(text: Column, most: int) -> Column:
    """The text up to the end of its `most`-th token."""
    parts = F.regexp_extract_all(text, F.lit(rf"[\s\p{{Z}}]*(?:{TOKEN})"), F.lit(0))
    return F.when(F.size(parts) <= most, text).otherwise(F.array_join(F.slice(parts, 1, most), ""))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE, -1), strip)
    return F.filter(parts, lambda s: s != "")


def statements(text: Column) -> Column:
    """Sentences by . ! ? and white space alone, of four words or more."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[\s\p{Z}]+", -1), lambda s: F.size(words(s)) >= 4)


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def snippet(text: Column, most: int = 320) -> Column:
    """White space collapsed; a longer text is cut at the last blank within `most` characters and marked."""
    flat = collapse(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, most), r" [^ ]*$", ""), F.lit("…")))


def expand_query(text: Column) -> Column:
    """The query followed by the expansions of its abbreviations, each once, in order of appearance."""
    table = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_-]*[\p{L}\p{N}_][\p{L}\p{N}_-]*"), F.lit(0))
    found = F.array_distinct(F.array_compact(F.transform(tokens, lambda t: F.try_element_at(table, F.regexp_replace(t, "^-+|-+$", "")))))
    return F.when(F.size(found) > 0, F.concat(text, F.lit(" "), F.array_join(found, " "))).otherwise(text)


def out_of_scope(text: Column) -> Column:
    return (F.length(strip(text)) < 3) | ~text.rlike(r"\p{L}")


def looks_like_heading(line: Column) -> Column:
    s = strip(line)
    w = words(s)
    capitals = F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
    upper = (F.upper(s) == s) & (F.lower(s) != s)
    numbered = s.rlike(r"^[0-9]") & s.rlike(r"\p{L}")
    titled = (F.size(w) >= 2) & (capitals >= 0.7 * F.size(w))
    return F.coalesce(F.length(s).between(3, 80) & ~s.rlike(r"[.,;]$") & (F.size(w) <= 10) & (upper | numbered | titled), F.lit(False))
