"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how the public byte-level vocabulary splits text before merging.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a rank file; read once a worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(text: str, enc) -> int:
    """Tokens of a text. A long one is counted in parts cut before a blank that follows a letter and leads to one,
    where the tokenizer always cuts too, for its time grows faster than the text where a pretoken is long."""
    if len(text) < 200_000:
        return len(enc.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = min(len(text), at + 100_000)
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and end + 1 < len(text) and text[end + 1].isalpha()):
            end += 1
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def token_sizes(df: DataFrame, keys: list[str], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """keys and n_tokens of each row; a null text has none. The narrow result is all that later steps shuffle."""
    narrow = df.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text__"))
    schema = ", ".join(f"{n} {t}" for n, t in narrow.dtypes[:-1]) + ", n_tokens long"

    def count(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            n = pa.array(np.fromiter((count_tokens(t, enc) for t in texts), np.int64, len(texts)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), n], names=[*keys, "n_tokens"])

    return narrow.mapInArrow(count, schema)
