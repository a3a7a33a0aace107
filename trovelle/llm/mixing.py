"""Problem 8: mixing sources to target weights by pivotal dependent rounding.

Each source of a mix gets a rate of copies a document, so that sources reach their shares of the
largest total that no source's repeats stand against. The whole part of the rate is given to every
document; the fractional parts are rounded in pairs: size moves at random from one document of a pair
to the other until one of them is whole, which keeps every document's expected copies and, to within
one document, the source's total. Pairing runs inside hash buckets of bounded size; what a bucket leaves
(one document at most) is paired with those of other buckets up a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelle.functions.npkern import mix, text_hashes
from trovelle.llm.sizes import TOKENIZER, token_sizes
from trovelle.session import cut

BUCKET = 20_000
FAN = 256
LEVELS = 4


def rates(targets: list[tuple[str, str, float, int]], totals: dict[str, int]) -> dict[tuple[str, str], float]:
    """Copies a document of each (mix, source). Sources without text get none, and their mixes the total of the others."""
    out: dict[tuple[str, str], float] = {}
    for name in sorted({t[0] for t in targets}):
        own = [t for t in targets if t[0] == name and t[2] > 0 and t[3] > 0 and totals.get(t[1], 0) > 0]
        if own:
            total = min(t[3] * totals[t[1]] / t[2] for t in own)
            for _, source, share, most in own:
                out[name, source] = min(float(most), share * total / totals[source])
    return out


def pivot(p: list[float], size: list[int], u: list[float]) -> int:
    """Rounds p in place, keeping sum(p * size); gives the place of the one that stays fractional, else -1."""
    near = 1e-9
    last = -1
    for i in range(len(p)):
        if near < p[i] < 1 - near:
            if size[i] == 0:
                p[i] = float(u[i] < p[i])
                continue
            if last < 0:
                last = i
                continue
            j = last
            a, b = size[i], size[j]
            up, down = min(a * (1 - p[i]), b * p[j]), min(a * p[i], b * (1 - p[j]))
            if u[i] * (up + down) < down:
                p[i], p[j] = p[i] + up / a, p[j] - up / b
            else:
                p[i], p[j] = p[i] - down / a, p[j] + down / b
            i_open, j_open = near < p[i] < 1 - near, near < p[j] < 1 - near
            last = i if i_open else j if j_open else -1
    return last


_SCHEMA = "mix_name string, source string, {key} {type}, n_tokens long, whole long, part double, bucket long"


def _uniform(h: np.ndarray, level: int) -> np.ndarray:
    """Reproducible numbers in [0, 1), independent from level to level."""
    return (mix(h.view(np.uint64) + np.uint64(level * 0x51ED27)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def mix_sources(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, seed: int = 8) -> DataFrame:
    """(mix_name, source, key, n_tokens, copies): the chosen texts, copies > 0.

    Sources are compared trimmed and in lower case; texts of a null source or one without a target are not
    chosen. Null keys are left out; of rows with the same key one counts (with most tokens). `targets`
    holds (mix_name, source, target_share, max_repeats), a fixed table of a few rows.
    """
    spark = documents.sparkSession
    wanted = [(r[0], r[1].strip().lower(), float(r[2]), int(r[3])) for r in targets.select("mix_name", "source", "target_share", "max_repeats").dropna().distinct().collect()]
    named = documents.where(F.col(key).isNotNull()).select(F.col(key).alias(key), F.lower(F.trim(source)).alias("source"), F.col(text).alias("text"))
    sizes = token_sizes(named, [key, "source"], "text", tokenizer)
    one = cut(sizes.groupBy(key).agg(F.max(F.struct("n_tokens", "source")).alias("m")).select(key, F.col("m.source").alias("source"), F.col("m.n_tokens").alias("n_tokens")))
    known = sorted({w[1] for w in wanted})
    counted = one.where(F.col("source").isin(known)).groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()  # one row a source with a target
    rate = rates(wanted, {r[0]: r[1] for r in counted})
    schema = _SCHEMA.format(key=key, type=dict(one.dtypes)[key])
    if not rate:
        return spark.createDataFrame([], schema).select("mix_name", "source", key, "n_tokens", F.col("whole").alias("copies"))
    table = spark.createDataFrame([(m, s, r) for (m, s), r in rate.items()], "mix_name string, source string, rate double")
    buckets = max(1, max(r[2] for r in counted) // BUCKET)
    start = one.join(F.broadcast(table), "source").select(
        "mix_name",
        "source",
        key,
        "n_tokens",
        F.floor("rate").alias("whole"),
        (F.col("rate") - F.floor("rate")).alias("part"),
        F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets)).alias("bucket"),
    )

    def level(n: int, last: bool):
        def step(group: pa.Table) -> pa.Table:
            keys = group.column(key).combine_chunks()
            h = text_hashes(pa.array([f"{seed}:{m}:{k}" for m, k in zip(group.column("mix_name").to_pylist(), keys.to_pylist())]))
            order = np.lexsort((h, -group.column("n_tokens").to_numpy()))  # long texts first, so that what stays open is short
            group, h = group.take(pa.array(order)), h[order]
            p, size, u = group.column("part").to_pylist(), group.column("n_tokens").to_pylist(), _uniform(h, n)
            rest = pivot(p, size, u.tolist())
            if last and rest >= 0:
                p[rest] = float(_uniform(h[rest : rest + 1], n + 97)[0] < p[rest])
            part = np.array(p)
            whole = group.column("whole").to_numpy() + (part > 1 - 1e-9)
            part = np.where((part > 1e-9) & (part < 1 - 1e-9), part, 0.0)
            up = group.column("bucket").to_numpy() // FAN
            return pa.table(
                {"mix_name": group["mix_name"], "source": group["source"], key: group[key], "n_tokens": group["n_tokens"], "whole": pa.array(whole.astype(np.int64)), "part": pa.array(part), "bucket": pa.array(up.astype(np.int64))}
            )

        return step

    rows, settled = start, None
    for n in range(LEVELS):
        last = n == LEVELS - 1 or buckets <= 1
        done = cut(rows.groupBy("mix_name", "source", "bucket").applyInArrow(level(n, last), schema))
        whole = done if last else done.where("part = 0")
        settled = whole if settled is None else settled.unionByName(whole)
        if last:
            break
        rows, buckets = done.where("part > 0"), (buckets + FAN - 1) // FAN
    return settled.where("whole > 0").select("mix_name", "source", key, "n_tokens", F.col("whole").alias("copies"))


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, n_texts, most_copies, total_tokens, reached_share) of each target."""
    size = F.col("n_tokens") * F.col("copies")
    got = chosen.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("n_texts"), F.max("copies").alias("most_copies"), F.sum(size).alias("total_tokens"))
    whole = got.groupBy("mix_name").agg(F.sum("total_tokens").alias("mix_tokens"))
    want = targets.select("mix_name", F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").dropna().distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    reached = F.coalesce(F.col("total_tokens") / F.nullif("mix_tokens", F.lit(0)), F.lit(0.0)).alias("reached_share")
    return want.join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left").select("mix_name", "source", "target_share", "max_repeats", zero("n_texts"), zero("most_copies"), zero("total_tokens"), reached)
