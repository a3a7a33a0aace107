"""Problem 7: items of varying length in containers of fixed capacity, by planning over the length histogram.

Only counts by length are planned: a histogram has at most `capacity` rows, however many documents
there are. The plan lists container templates (how many items of which length) with multiplicities;
each step takes the longest length left, fills the gap exactly if one or two lengths can, else with
the longest that fits, and repeats that template while the counts last. Documents then take planned
slots by their rank within their length. Ranks are taken in salted parts, so that a length that a
third of the documents share is ranked by many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovelle.llm.sizes import TOKENIZER, token_sizes
from trovelle.session import cut, partitions


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(items by length, multiplicity) of each container template, using up all counts; lengths are 1 .. capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    left[0] = 0
    out: list[tuple[dict[int, int], int]] = []
    while left.any():
        used: dict[int, int] = {}
        now = left.copy()

        def take(size: int) -> None:
            now[size] -= 1
            used[size] = used.get(size, 0) + 1

        first = int(np.flatnonzero(now)[-1])
        take(first)
        room = capacity - first
        while room > 0:
            if now[room]:
                take(room)
                break
            have = now[1:room] > 0
            if not have.any():
                break
            pair = np.flatnonzero(have & have[::-1])
            pair = pair[(pair + 1 != room - pair - 1) | (now[pair + 1] > 1)]
            if len(pair):
                a = int(pair[-1]) + 1
                take(a)
                take(room - a)
                break
            best = int(np.flatnonzero(have)[-1]) + 1
            take(best)
            room -= best
        times = min(int(left[s] // n) for s, n in used.items())
        for s, n in used.items():
            left[s] -= n * times
        out.append((used, times))
    return out


class Slots:
    """The slots of the plans of all kinds: slot numbers run over (kind, length, rank)."""

    def __init__(self, plans: dict[str, list[tuple[dict[int, int], int]]], capacity: dict[str, int]):
        parts: dict[tuple[str, int], list[tuple[int, int, int, int]]] = {}
        for kind, templates in plans.items():
            container = 0
            for used, times in templates:
                unused = capacity[kind] - sum(s * n for s, n in used.items())
                for s, n in used.items():
                    parts.setdefault((kind, s), []).append((n * times, container, n, unused))
                container += times
        self.base: dict[tuple[str, int], int] = {}
        start, first, per, unused, at = [], [], [], [], 0
        for key, rows in parts.items():
            self.base[key] = at
            for slots, container, n, free in rows:
                start.append(at)
                first.append(container)
                per.append(n)
                unused.append(free)
                at += slots
        self.start, self.first, self.per, self.unused = (np.array(x, np.int64) for x in (start, first, per, unused))

    def find(self, kinds: list[str], sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Container and its unused space for each (kind, length, rank)."""
        slot = np.fromiter((self.base[k, s] for k, s in zip(kinds, sizes.tolist())), np.int64, len(sizes)) + ranks
        i = np.searchsorted(self.start, slot, side="right") - 1
        return self.first[i] + (slot - self.start[i]) // self.per[i], self.unused[i]


def pack(documents: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(container_kind, container_id, key, piece, token_start, n_tokens, capacity, unused): where each text goes.

    A text of more than the capacity is split: full pieces, each filling a container, and the rest as an
    item of its own. Null keys are left out; of rows with the same key one counts (that with most tokens).
    Null and empty texts need no room: they come out with container_id null and n_tokens 0. `containers` holds
    (container_kind, capacity_tokens), a fixed handful of rows; those without a positive capacity are left out.
    """
    spark = documents.sparkSession
    kinds = {r[0]: int(r[1]) for r in containers.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens")).collect()}
    sized = token_sizes(documents.where(F.col(key).isNotNull()), [key], text, tokenizer)
    sizes = cut(sized.groupBy(key).agg(F.max("n_tokens").alias("total")))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(kinds.items())))) if kinds else None
    schema = f"container_kind string, container_id long, {key} {dict(sizes.dtypes)[key]}, piece long, token_start long, n_tokens long, capacity long, unused long"
    if each is None:
        return spark.createDataFrame([], schema)
    items = sizes.select(key, "total", each.alias("k")).select(key, "total", "k.*")
    items = items.select("container_kind", "capacity", key, "total", F.explode(F.expr("sequence(0L, greatest(0L, (total - 1) div capacity))")).alias("piece"))
    items = items.withColumn("token_start", F.col("piece") * F.col("capacity")).withColumn("n_tokens", F.least("capacity", F.col("total") - F.col("token_start"))).drop("total")
    held = items.where("n_tokens > 0")
    counts: dict[str, dict[int, int]] = {k: {} for k in kinds}
    for r in held.groupBy("container_kind", "n_tokens").count().collect():  # at most the sum of the capacities
        counts[r[0]][r[1]] = r[2]
    slots = Slots({k: plan(n, kinds[k]) for k, n in counts.items()}, kinds)
    salted = held.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(max(8, partitions(spark)))).cast("int"))
    group = ["container_kind", "n_tokens", "salt"]
    within = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(key, "piece")) - 1)
    before = Window.partitionBy("container_kind", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = within.join(offsets, group).select("container_kind", key, "piece", "token_start", "n_tokens", "capacity", (F.col("rank") + F.col("offset")).cast("long").alias("rank"))

    def place(batches):
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            container, unused = slots.find(c["container_kind"].to_pylist(), c["n_tokens"].to_numpy(), c["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [c["container_kind"], pa.array(container), c[key], c["piece"], c["token_start"], c["n_tokens"], c["capacity"], pa.array(unused)],
                names=["container_kind", "container_id", key, "piece", "token_start", "n_tokens", "capacity", "unused"],
            )

    none = items.where("n_tokens <= 0").select("container_kind", F.lit(None).cast("long").alias("container_id"), key, "piece", "token_start", F.lit(0).cast("long").alias("n_tokens"), "capacity", F.lit(None).cast("long").alias("unused"))
    return ranked.mapInArrow(place, schema).unionByName(none)


def fill(placed: DataFrame) -> DataFrame:
    """(container_kind, containers, capacity, used, unused, unused_share) over all containers of a kind."""
    one = placed.where("container_id is not null").groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"), F.first("capacity").alias("capacity"))
    total = one.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.first("capacity").alias("capacity"), F.sum("used").alias("used"))
    room = F.col("containers") * F.col("capacity")
    return total.select("container_kind", "containers", "capacity", "used", (room - F.col("used")).alias("unused"), ((room - F.col("used")) / room).alias("unused_share"))
