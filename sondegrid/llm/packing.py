"""Filling containers of fixed capacity.

The plan is made on the histogram of sizes, which has at most ``capacity`` rows however many items there are: items above a
third of the capacity are matched, largest with the largest that still fits, so at most two share a container; smaller
sizes, largest first, go where the gap that remains is least. A step of the plan puts t items of one size into each of n
containers in a row. Items find their step by their rank within their size; ranks are counted in salted groups.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sondegrid.session import materialize

SALTS = 256


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Steps (size, first rank, items in each container, first container), and the number of containers.

    Sizes are 1..capacity. Deterministic; an empty histogram gives no step."""
    left = {s: n for s, n in histogram.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap to runs of containers (first, number)
    bins = 0

    def put(size: int, n: int, each: int, first: int) -> None:
        steps.append((size, taken[size], each, first))
        taken[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    for a in reversed(large):
        while left[a]:
            b = next((x for x in reversed(large[: bisect.bisect_right(large, min(a, capacity - a))]) if left[x]), None)
            if b is None:
                n, gap = left[a], capacity - a
                put(a, n, 1, bins)
            elif b == a:
                n, gap = max(1, left[a] // 2), capacity - a * (2 if left[a] > 1 else 1)
                put(a, n * min(2, left[a]), min(2, left[a]), bins)
            else:
                n, gap = min(left[a], left[b]), capacity - a - b
                put(a, n, 1, bins)
                put(b, n, 1, bins)
            gaps.setdefault(gap, []).append((bins, n))
            bins += n
    order = sorted(gaps)
    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[s]:
            k = bisect.bisect_left(order, s)
            if k == len(order):
                gap, (first, n) = capacity, (bins, -(-left[s] // (capacity // s)))
                bins += n
            else:
                gap = order[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    del order[k]
            each = gap // s
            full = min(n, left[s] // each)
            rest = left[s] - full * each if full < n else 0
            for at, m, t in ((first, full, each), (first + full, int(rest > 0), rest), (first + full + int(rest > 0), n - full - int(rest > 0), 0)):
                if m:
                    if t:
                        put(s, m * t, t, at)
                    if (g := gap - t * s) > 0:
                        if g not in gaps:
                            gaps[g] = []
                            bisect.insort(order, g)
                        gaps[g].append((at, m))
    return np.array(sorted(steps), np.int64).reshape(-1, 4), bins


def split_items(sizes: DataFrame, capacity: int, id_col: str, size_col: str) -> DataFrame:
    """(id, piece, size): an item beyond the capacity is split into full pieces and a rest; sizes that are null or below 1 are left out."""
    n = F.col(f"`{size_col}`").cast("long")
    d = sizes.select(F.col(f"`{id_col}`").alias("k"), n.alias("n")).where("n > 0")
    last = F.ceil(F.col("n") / F.lit(capacity)).cast("int") - 1
    d = d.withColumn("last", last).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return d.select("k", "piece", F.when(F.col("piece") < F.col("last"), F.lit(capacity)).otherwise(F.col("n") - F.col("last") * F.lit(capacity)).cast("int").alias("size"))


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(id, piece, n_tokens, bin) for items of integer size.

    Null, zero and negative sizes are left out; only items beyond the capacity are split, into pieces from 0; repeated rows
    are separate items; null ids are kept; other columns are left out; an empty table gives no rows."""
    items = materialize(split_items(sizes, capacity, id_col, size_col).withColumn("salt", F.pmod(F.xxhash64("k", "piece"), F.lit(SALTS)).cast("int")), "pack-items")
    counts = items.groupBy("size", "salt").agg(F.count("*").alias("n"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    steps, _ = plan(histogram, capacity)
    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy("k", "piece")) - 1
    ranked = items.withColumn("r", rank).join(offsets, ["size", "salt"]).select("k", "piece", "size", (F.col("r") + F.col("before")).alias("rank"))
    kind = ranked.schema["k"].dataType
    key = steps[:, 0] * (1 << 48) + steps[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, at = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), b.column(3).to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, size * (1 << 48) + at, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(steps[i, 3] + (at - steps[i, 1]) // np.maximum(steps[i, 2], 1), pa.int64())], ["k", "piece", "size", "bin"])

    schema = T.StructType([T.StructField("k", kind), T.StructField("piece", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("bin", T.LongType())])
    return ranked.mapInArrow(run, schema).toDF(id_col, "piece", size_col, "bin")
