"""Consolidating pairwise matches into groups by low-diameter decomposition.

Every level draws an exponential shift for each vertex; vertex ``v`` starts growing a cluster at time
``rounds - min(shift, rounds)`` and reaches a neighbour one time unit later, so each vertex joins the cluster that
arrives first (``min`` over centres of start time + distance). Clusters become super-vertices, edges between clusters
form the next level's graph, and the recursion ends when no such edge is left. The per-level assignments are then
composed from the last level back to the first.

Each level removes a constant share of the vertices whatever the shape of the graph (chains, stars, cliques), so levels
grow with the logarithm of the largest component. All steps are joins and map-side combined minima; edges of vertices
with a large share of the edges meet a broadcast of those at most HOT_PARTS vertices (operators.skew). With shifts of rate BETA about
one edge in three is cut at a level; ROUNDS bounds the growth. The recursion's base is a graph of at most SMALL_EDGES edges,
which one task finishes by union-find.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.skew import hot_keys, in_list, skew_join
from kinloom.session import Scratch, is_empty

BETA = 0.4
ROUNDS = 6
SMALL_EDGES = 2_000
SALTS = 32
# Rounds in one plan: longer plans take the driver more memory than their writing takes time.
PLANNED = 3


def _start(v: str, level: int, beta: float, rounds: int):
    """Start time in [0, rounds] from an exponential shift that depends on the vertex and the level alone."""
    u = (F.pmod(F.xxhash64(F.col(v), F.lit(level)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.greatest(F.lit(0.0), F.lit(float(rounds)) + F.log(u) / F.lit(beta))


def _grow(scratch: Scratch, edges: DataFrame, level: int, beta: float, rounds: int, hot: list, spent: list) -> DataFrame:
    """(v, c): the centre c whose cluster reaches v first; edges (a, b) are long ids, each once, a < b.

    A round refers to the state once, so that the plan grows with the rounds and no faster: each edge carries its sender's
    state to both ends. Edges of hot senders are salted by their other end, and the sender's state is copied to each salt.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    salted = both.withColumn("s", F.when(in_list(F.col("a"), hot), F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    state = both.select(F.col("a").alias("v")).distinct().withColumn("at", F.struct(_start("v", level, beta, rounds).alias("t"), F.col("v").alias("c")))
    salts = F.when(in_list(F.col("v"), hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    for k in range(rounds):
        if k and k % PLANNED == 0:
            state = scratch.write(state)
            spent.append(state)
        sender = state.select(F.col("v").alias("a"), "at", F.explode(salts).alias("s"))
        later = F.struct((F.col("at.t") + 1).alias("t"), F.col("at.c").alias("c"))
        # a cluster that would arrive after the last possible start can't win, so it isn't sent
        told = F.when(F.col("at.t") <= rounds - 1, F.array(F.struct(F.col("a").alias("v"), "at"), F.struct(F.col("b").alias("v"), later.alias("at")))).otherwise(F.array(F.struct(F.col("a").alias("v"), "at")))
        state = salted.join(sender, ["a", "s"]).select(F.explode(told).alias("x")).groupBy("x.v").agg(F.min("x.at").alias("at"))
    return state.select("v", F.col("at.c").alias("c"))


def _contract(edges: DataFrame, clusters: DataFrame, hot: list) -> DataFrame:
    x = skew_join(edges, clusters.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a", "inner", hot)
    x = skew_join(x, clusters.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b", "inner", hot)
    return x.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def _finish(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex c of the component of v, by union-find in one task."""
    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for a, b in zip(pdf.a.tolist(), pdf.b.tolist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return pd.DataFrame({"v": list(parent), "c": [root(v) for v in list(parent)]})

    return edges.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(unite, "v bigint, c bigint")


def decompose(spark: SparkSession, edges: DataFrame, scratch: Scratch, beta: float = BETA, rounds: int = ROUNDS, small: int = SMALL_EDGES) -> DataFrame | None:
    """(v, c) with one c for each component of ``edges`` (a, b: long ids, each pair once, a < b); None if no edge."""
    level, maps, edges = 0, [], scratch.write(edges)
    while not is_empty(edges):
        if edges.count() <= small:
            maps.append(scratch.write(_finish(edges)))
            scratch.drop(edges)
            break
        both = edges.select(F.explode(F.array("a", "b")).alias("a"))
        hot = hot_keys(both, "a")
        spent: list = []
        clusters = scratch.write(_grow(scratch, edges, level, beta, rounds, hot, spent))
        following = scratch.write(_contract(edges, clusters, hot))
        scratch.drop(edges, *spent)
        maps.append(clusters)
        edges, level = following, level + 1
    if not maps:
        return None
    whole = maps.pop()
    while maps:
        lower = maps.pop()
        joined = skew_join(lower.select("v", F.col("c").alias("k")), whole.select(F.col("v").alias("k"), "c"), "k", "left")
        composed = scratch.write(joined.select("v", F.coalesce("c", "k").alias("c")))
        scratch.drop(lower, whole)
        whole = composed
    return whole


def connected_groups(spark: SparkSession, links: DataFrame, left: str, right: str, beta: float = BETA, rounds: int = ROUNDS, small: int = SMALL_EDGES) -> DataFrame:
    """(record string, group_key string): one row for each distinct record in either column.

    group_key is the smallest record, in byte order, of all records linked to this one directly or through others. A
    null side is a missing record: it joins nothing. Links to oneself, repeated links and links in both directions
    change nothing; a record without links is its own group; an empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(spark, "groups")
    pairs = scratch.write(links.select(F.col(left).cast("string").alias("x"), F.col(right).cast("string").alias("y")).distinct())
    names = scratch.write(pairs.select(F.explode(F.array("x", "y")).alias("record")).where("record is not null").distinct()
                          .withColumn("v", F.monotonically_increasing_id()))
    full = pairs.where("x is not null and y is not null and x <> y")
    edges = skew_join(full, names.select(F.col("record").alias("x"), F.col("v").alias("vx")), "x")
    edges = skew_join(edges, names.select(F.col("record").alias("y"), F.col("v").alias("vy")), "y")
    edges = edges.select(F.least("vx", "vy").alias("a"), F.greatest("vx", "vy").alias("b")).distinct()
    whole = decompose(spark, edges, scratch, beta, rounds, small)
    if whole is None:
        return names.select("record", F.col("record").alias("group_key"))
    member = scratch.write(names.join(whole, "v", "left").select("record", F.coalesce("c", "v").alias("c")))
    keys = member.groupBy("c").agg(F.min("record").alias("group_key"))
    return skew_join(member, keys, "c").select("record", "group_key")
