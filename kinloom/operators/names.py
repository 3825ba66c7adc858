"""Matching of short lists of names: predicates, attributes and what hangs on them. Lists are those of a vocabulary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kinloom.operators.skew import block_join
from kinloom.session import Scratch


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the common subsequence over both lengths; 1 for two empty texts."""
    return pd.Series([2 * common_length(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(a, b)], dtype="float64")


def letters(c: str):
    return F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != ""))


def mutual_best(one: DataFrame, two: DataFrame, least: float) -> DataFrame:
    """(x, y, sim): names (x) and (y) that are each other's most alike, above ``least``; ties by name.

    Pairs are formed by shared letters, since names without one have ratio 0.
    """
    a = one.select("x").distinct().withColumn("k", F.explode(letters("x")))
    b = two.select("y").distinct().withColumn("k", F.explode(letters("y")))
    sims = a.join(b, "k").select("x", "y").distinct().withColumn("sim", indel_ratio("x", "y"))
    best_x, best_y = Window.partitionBy("x").orderBy(F.desc("sim"), "y"), Window.partitionBy("y").orderBy(F.desc("sim"), "x")
    return sims.withColumn("a", F.row_number().over(best_x)).withColumn("b", F.row_number().over(best_y)).where((F.col("a") == 1) & (F.col("b") == 1) & (F.col("sim") > least)).select("x", "y", "sim")


def refreshed(names: DataFrame, vectors: DataFrame, threshold: float, share: float = 0.7) -> DataFrame:
    """(x, y, w): pairs mutual in both with their weighted similarity, above a soft threshold."""
    x = names.join(vectors.select("x", "y", F.col("sim").alias("vsim")), ["x", "y"])
    return x.select("x", "y", (share * F.col("sim") + (1 - share) * F.col("vsim")).alias("w")).where(F.col("w") > threshold)


def mediated(attributes1: DataFrame, attributes2: DataFrame, pairs: DataFrame, least: float = 0.0, digits: int | None = None) -> DataFrame:
    """(e1, e2, sim): entities with an equal value of an aligned attribute pair (a1, a2), and the share of their aligned attributes that agree, above ``least``.

    Entities of equal facts are compared once, as a kind. As at least some number of a kind's attributes must agree, it is
    looked up by its rarest ones only, so many that one of them is always among those. Members of matching kinds are paired last.
    """
    scratch = Scratch(attributes1.sparkSession, "mediated")
    one = attributes1.join(F.broadcast(pairs), attributes1.a == pairs.a1).select(F.col("e").alias("e1"), "a1", "a2", F.lower("v").alias("v")).where("e1 is not null")
    two = attributes2.select(F.col("e").alias("e2"), F.col("a").alias("a2"), F.lower("v").alias("v")).where("a2 is not null and v is not null")
    kind = lambda name, *of: F.unhex(F.sha2(F.to_json(F.struct(*of)), 256)).alias(name)
    told = one.groupBy("e1").agg(F.sort_array(F.collect_set(F.struct("a1", "a2", "v"))).alias("fs")).select("e1", F.size(F.array_distinct("fs.a1")).alias("m"), F.filter("fs", lambda f: f.v.isNotNull()).alias("f1"))
    said = two.groupBy("e2").agg(F.sort_array(F.collect_set(F.struct("a2", "v"))).alias("f2"))
    members1, members2 = scratch.write(told.select("e1", kind("p1", "m", "f1"), "m", "f1")), scratch.write(said.select("e2", kind("p2", "f2"), "f2"))
    kinds1, kinds2 = members1.select("p1", "m", "f1").dropDuplicates(["p1"]), members2.select("p2", "f2").dropDuplicates(["p2"])

    facts2 = kinds2.select("p2", F.inline("f2"))
    facts1 = kinds1.select("p1", "m", F.inline("f1")).join(facts2.groupBy("a2", "v").agg(F.count(F.lit(1)).alias("met")), ["a2", "v"], "left")
    costs = facts1.groupBy("p1", "m", "a1").agg(F.sum(F.coalesce("met", F.lit(0))).alias("cost"))
    needed = F.array_min(F.filter(F.sequence(F.lit(1), "m"), lambda n: n / F.col("m") > least))
    # attributes without a value can't agree: they are the rarest
    rank = F.row_number().over(Window.partitionBy("p1").orderBy("cost", "a1")) + F.col("m") - F.count(F.lit(1)).over(Window.partitionBy("p1"))
    rarest = costs.withColumn("k", rank).where(F.col("k") <= F.col("m") - needed + 1).select("p1", "a1")
    met = facts1.join(rarest, ["p1", "a1"]).join(facts2, ["a2", "v"]).select("p1", "p2").distinct()
    agreed = F.array_distinct(F.transform(F.filter("f1", lambda f: F.array_contains("f2", F.struct(f.a2, f.v))), lambda f: f.a1))
    sim = F.size(agreed) / F.col("m")
    alike = met.join(kinds1, "p1").join(kinds2, "p2").select("p1", "p2", sim.alias("sim")).where(F.col("sim") > least)
    alike = scratch.write(alike if digits is None else alike.withColumn("sim", F.round("sim", digits)))
    return block_join(members1.select("e1", "p1").join(alike, "p1").select("e1", "p2", "sim"), members2.select("e2", "p2"), "p2").select("e1", "e2", "sim")


def attribute_votes(attributes1: DataFrame, attributes2: DataFrame, links: DataFrame) -> DataFrame:
    """(a1, a2, sim): attributes of linked entities and how often their values agree."""
    x = attributes1.join(links, attributes1.e == links.e1).select("e2", F.col("a").alias("a1"), F.col("v").alias("v1"))
    y = attributes2.select(F.col("e").alias("e2"), F.col("a").alias("a2"), F.col("v").alias("v2"))
    return x.join(y, "e2").groupBy("a1", "a2").agg(F.avg((F.lower("v1") == F.lower("v2")).cast("double")).alias("sim"))
