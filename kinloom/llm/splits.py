"""Splits that keep related records together: components, then largest-differencing balance into equal bins.

Groups are ordered by weight. Equal weights that fill whole rounds of ``bins`` cancel at once: group number i of its weight
goes to bin i mod ``bins``. What is left, fewer than ``bins`` groups of each distinct weight, is balanced by the largest-
differencing method: the two partial solutions with the greatest spread are combined, largest bins onto smallest, until one
is left. As n rows have at most sqrt(2 n) distinct group weights, that remainder is small at any size; one task takes it.
Whole bins are then allocated to the splits by what each still lacks of its target.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.components import connected_groups
from kinloom.operators.skew import skew_join
from kinloom.session import Scratch

BINS = 100


def difference(tuples: list[tuple[np.ndarray, list[list]]]) -> tuple[np.ndarray, list[list]]:
    """Combine (sums, members by bin) two at a time, greatest spread first, until one is left."""
    order = itertools.count()
    heap = [(-(s.max() - s.min()), next(order), s, m) for s, m in tuples]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, s, m = heapq.heappop(heap)
        _, _, t, n = heapq.heappop(heap)
        down, up = np.argsort(-s, kind="stable"), np.argsort(t, kind="stable")
        sums = s[down] + t[up]
        members = [m[i] + n[j] if n[j] else m[i] for i, j in zip(down, up)]
        heapq.heappush(heap, (-(sums.max() - sums.min()), next(order), sums, members))
    return heap[0][2], heap[0][3]


def balance(weights: np.ndarray, counts: np.ndarray, bins: int) -> tuple[list[tuple[float, int, int]], np.ndarray]:
    """(weight, number, bin) of the groups that whole rounds leave over, and the sums of all bins."""
    sums, rest = np.full(bins, float((weights * (counts // bins)).sum())), []
    for w, c in zip(weights.tolist(), counts.tolist()):
        for i in range(c // bins * bins, c):
            s = np.zeros(bins)
            s[0] = w
            rest.append((s, [[(w, i)], *[[] for _ in range(bins - 1)]]))
    placed = []
    if rest:
        more, members = difference(rest)
        sums = sums + more
        placed = [(w, i, b) for b, items in enumerate(members) for w, i in items]
    return placed, sums


def allocate(sums: np.ndarray, targets: list[tuple[str, float]]) -> list[str | None]:
    """Split of each bin: heaviest bins first, each to the split that lacks most of its target; None without targets."""
    if not targets:
        return [None] * len(sums)
    scale = sum(t for _, t in targets)
    lack = [t / scale * float(sums.sum()) for _, t in targets]
    out = [""] * len(sums)
    for b in np.argsort(-sums, kind="stable"):
        k = max(range(len(lack)), key=lambda i: (lack[i], -i))
        out[b] = targets[k][0]
        lack[k] -= float(sums[b])
    return out


def assign_groups(spark: SparkSession, groups: DataFrame, key: str, weight: str, targets: list[tuple[str, float]], bins: int = BINS) -> DataFrame:
    """(key, bin int, split string) for each row of ``groups`` (one row a group, weight > 0)."""
    scratch = Scratch(spark, "splits")
    ordered = groups.select(F.col(key).alias("k"), F.col(weight).cast("double").alias("w")).orderBy(F.desc("w"), "k")
    rows = scratch.write(ordered.withColumn("m", F.monotonically_increasing_id()))
    place = rows.select("k", "w", F.shiftright("m", 33).alias("part"), F.expr("m & 8589934591").alias("i"))
    offsets, total = [], 0
    for r in place.groupBy("part").count().orderBy("part").collect():
        offsets.append((r["part"], total))
        total += r["count"]
    at = place.join(F.broadcast(spark.createDataFrame(offsets, "part bigint, shift bigint")), "part").select("k", "w", (F.col("i") + F.col("shift")).alias("at"))
    sizes = scratch.write(at.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start")))

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("w", ascending=False)
        placed, sums = balance(pdf.w.to_numpy(), pdf.n.to_numpy(), bins)
        return pd.DataFrame(placed + [(float(x), -1, b) for b, x in enumerate(sums)], columns=["w", "i", "b"])

    plan = scratch.write(sizes.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(share, "w double, i bigint, b bigint"))
    sums = np.zeros(bins)
    for r in plan.where("i < 0").collect():
        sums[r.b] = r.w
    splits = allocate(sums, targets)
    numbered = skew_join(at, sizes, "w").select("k", "w", (F.col("at") - F.col("start")).alias("i"), "n")
    whole = F.col("i") < F.col("n") - F.col("n") % bins
    left = numbered.where(~whole).join(plan.where("i >= 0"), ["w", "i"]).select("k", F.col("b").cast("int").alias("bin"))
    every = numbered.where(whole).select("k", (F.col("i") % bins).cast("int").alias("bin")).unionByName(left)
    return every.select(F.col("k").alias(key), "bin", F.array(*[F.lit(s).cast("string") for s in splits])[F.col("bin")].alias("split"))


def grouped_splits(spark: SparkSession, rows: DataFrame, row_id: str, left: str, right: str, targets: list[tuple[str, float]], bins: int = BINS) -> DataFrame:
    """(row_id, group_key, first_id, bin, split): every row of ``rows`` with its group and split.

    Rows that touch a common record (columns left and right, null = missing) directly or through other rows share a
    group and therefore a split; a row without any record is a group of its own (group_key null). first_id is the
    smallest row_id of the group. Shares are met as near as whole bins and the largest group allow. Rows repeated with
    the same row_id and no record form one group; without targets split is null; each row with a null row_id and no record is its own.
    """
    scratch = Scratch(spark, "rowgroups")
    records = connected_groups(spark, rows, left, right)
    named = rows.select(F.col(row_id).alias("id"), F.coalesce(F.col(left), F.col(right)).cast("string").alias("record"))
    grouped = skew_join(named, records, "record", "left").select("id", "group_key", F.monotonically_increasing_id().alias("row"))
    # copies of a row without record stay together by their id; without an id there is nothing to tell them by
    unit = F.coalesce("group_key", F.concat(F.lit("\x00i"), F.col("id").cast("string")), F.concat(F.lit("\x00r"), F.col("row").cast("string")))
    keyed = scratch.write(grouped.select("id", "group_key", unit.alias("unit")))
    units = scratch.write(keyed.groupBy("unit").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("w")))
    placed = assign_groups(spark, units, "unit", "w", targets, bins).join(units.select("unit", "first_id"), "unit")
    return skew_join(keyed, placed, "unit").select(F.col("id").alias(row_id), "group_key", "first_id", "bin", "split")
