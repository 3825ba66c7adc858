"""Vectors (id, vec array<double>): similarity search in blocks, rankings, alignment and what is measured on them.

A search is a stated query set against all rows: query blocks of at most BLOCK vectors are broadcast, each batch of the
corpus keeps its best k for every query, and the batches' bests are merged. All pairs are never written.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 4096


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def similarities(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """inner: dot; cosine: of unit vectors; euclidean and manhattan: one less the distance."""
    if metric == "inner":
        return q @ c.T
    if metric == "cosine":
        return unit(q) @ unit(c).T
    if metric == "euclidean":
        return 1 - np.stack([np.sqrt(((c - x) ** 2).sum(axis=1)) for x in q])
    if metric == "manhattan":
        return 1 - np.stack([np.abs(c - x).sum(axis=1) for x in q])
    raise ValueError(metric)


def _blocks(spark: SparkSession, queries: DataFrame) -> Iterator:
    rows = queries.toLocalIterator()
    for block in iter(lambda: list(itertools.islice(rows, BLOCK)), []):
        yield spark.sparkContext.broadcast(([r[0] for r in block], matrix([r[1] for r in block]), np.array([r[2] if len(r) > 2 else 0.0 for r in block])))


def search(spark: SparkSession, queries: DataFrame, corpus: DataFrame, k: int, metric: str = "inner", scale: float = 1.0) -> DataFrame:
    """(i, j, sim, rank): the k best corpus rows of each query, ties by j; sim = scale * metric + both biases, if given.

    ``queries`` and ``corpus`` are (id bigint, vec array<double>[, bias double]).
    """
    c = corpus.select(F.col(corpus.columns[0]).alias("j"), F.col(corpus.columns[1]).alias("vec"), (F.col(corpus.columns[2]) if len(corpus.columns) > 2 else F.lit(0.0)).alias("bias"))
    out = None
    for block in _blocks(spark, queries):
        def best(parts: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            ids, q, bias = block.value
            for part in parts:
                s = scale * similarities(q, matrix(part.vec), metric) + bias[:, None] + part.bias.to_numpy()[None, :]
                js = part.j.to_numpy()
                order = np.argsort(js, kind="stable")
                s, js = s[:, order], js[order]
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"i": np.repeat(ids, top.shape[1]), "j": js[top].ravel(), "sim": np.take_along_axis(s, top, axis=1).ravel()})

        rows = c.mapInPandas(best, "i bigint, j bigint, sim double")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "i bigint, j bigint, sim double, rank bigint")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "j"))
    return out.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def combined(a: str | Column, b: str | Column, of) -> Column:
    return F.aggregate(F.zip_with(a, b, of), F.lit(0.0), lambda s, x: s + x)


def pair_similarity(pairs: DataFrame, one: DataFrame, two: DataFrame, metric: str = "inner") -> DataFrame:
    """(i, j, sim) of given pairs (i, j), as often as they are given."""
    x = pairs.join(one.select(F.col("id").alias("i"), F.col("vec").alias("x")), "i").join(two.select(F.col("id").alias("j"), F.col("vec").alias("y")), "j")
    sims = {"inner": dot("x", "y"), "cosine": F.when(norm("x") * norm("y") > 0, dot("x", "y") / (norm("x") * norm("y"))).otherwise(0.0),
            "euclidean": 1 - F.sqrt(combined("x", "y", lambda a, b: (a - b) * (a - b))), "manhattan": 1 - combined("x", "y", lambda a, b: F.abs(a - b))}
    return x.select("i", "j", sims[metric].alias("sim"))


def gold_ranks(spark: SparkSession, queries: DataFrame, corpus: DataFrame, gold: DataFrame, scale: float = 1.0) -> DataFrame:
    """(i, rank): one more than the corpus rows nearer to query i than its gold row (i, sim); counted by batch."""
    at = queries.join(gold.select(F.col("i").alias(queries.columns[0]), F.col("sim").alias("_gold")), queries.columns[0])
    bias = F.col(queries.columns[2]) if len(queries.columns) > 2 else F.lit(0.0)
    at = at.select(queries.columns[0], queries.columns[1], (bias - F.col("_gold")).alias("bias"))
    c = corpus.select(F.col(corpus.columns[1]).alias("vec"), (F.col(corpus.columns[2]) if len(corpus.columns) > 2 else F.lit(0.0)).alias("bias"))
    out = None
    for block in _blocks(spark, at):
        def above(parts: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            ids, q, less = block.value
            n = np.zeros(len(ids), dtype=np.int64)
            for part in parts:
                n += (scale * similarities(q, matrix(part.vec), "inner") + less[:, None] + part.bias.to_numpy()[None, :] > 1e-12).sum(axis=1)
            yield pd.DataFrame({"i": ids, "n": n})

        rows = c.mapInPandas(above, "i bigint, n bigint")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "i bigint, rank bigint")
    return out.groupBy("i").agg((F.sum("n") + 1).alias("rank"))


def retrieval_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 50)) -> DataFrame:
    """One row: Hits@k in per cent, mean rank, mean reciprocal rank."""
    return ranks.agg(*[F.round(F.avg((F.col("rank") <= k).cast("double")) * 100, 3).alias(f"hits_{k}") for k in ks], F.round(F.avg("rank"), 4).alias("mr"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"))


def neighbour_means(spark: SparkSession, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(i, r): mean similarity of each query's k nearest."""
    return search(spark, queries, corpus, k).groupBy("i").agg(F.avg("sim").alias("r"))


def with_bias(vectors: DataFrame, means: DataFrame) -> DataFrame:
    """(id, vec, bias): the bias is less the neighbour mean."""
    return vectors.join(means.select(F.col("i").alias("id"), (-F.col("r")).alias("bias")), "id").select("id", "vec", "bias")


def csls(spark: SparkSession, one: DataFrame, two: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the biases that make scale-2 inner products cross-domain similarity local scaling."""
    return with_bias(one, neighbour_means(spark, one, two, k)), with_bias(two, neighbour_means(spark, two, one, k))


def stable_matching(scratch, candidates: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(i, j, sim): suitors i propose in order of sim, j keeps the best; ties by id. One pass a round, until nobody is left
    or ``most_rounds``; without ties the result doesn't depend on the order of proposals."""
    order = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "j"))
    ranked = scratch.write(candidates.withColumn("k", order))
    at, held = ranked.select("i").distinct().withColumn("k", F.lit(1)), None
    for _ in range(most_rounds):
        offers = at.join(ranked, ["i", "k"]).select("i", "j", "sim", "k")
        best = scratch.write(offers.withColumn("won", F.row_number().over(Window.partitionBy("j").orderBy(F.desc("sim"), "i")) == 1))
        lost = best.where("not won")
        held = best.where("won").select("i", "j", "sim")
        if not lost.take(1):
            break
        at = best.select("i", F.when(F.col("won"), F.col("k")).otherwise(F.col("k") + 1).alias("k"))
    return held


def dominant_matching(scratch, edges: DataFrame) -> DataFrame:
    """(i, j, sim): a matching of at least half the greatest weight: edges best at both ends are taken until none is left."""
    rest, out = scratch.write(edges.select("i", "j", "sim")), None
    while rest.take(1):
        best_i, best_j = Window.partitionBy("i").orderBy(F.desc("sim"), "j"), Window.partitionBy("j").orderBy(F.desc("sim"), "i")
        taken = scratch.write(rest.withColumn("a", F.row_number().over(best_i)).withColumn("b", F.row_number().over(best_j)).where("a = 1 and b = 1").select("i", "j", "sim"))
        out = taken if out is None else out.unionByName(taken)
        rest = scratch.write(rest.join(taken.select("i"), "i", "left_anti").join(taken.select("j"), "j", "left_anti"))
    return edges.select("i", "j", "sim").limit(0) if out is None else out


def edit_alignment(old: DataFrame, new: DataFrame) -> DataFrame:
    """(i, j, sim): a new partner replaces the old if at least as similar; then each j keeps its most similar i."""
    x = old.select("i", F.col("j").alias("jo"), F.col("sim").alias("so")).join(new.select("i", F.col("j").alias("jn"), F.col("sim").alias("sn")), "i", "full")
    take = F.col("so").isNull() | (F.col("sn") >= F.col("so"))
    y = x.select("i", F.when(take, F.col("jn")).otherwise(F.col("jo")).alias("j"), F.when(take, F.col("sn")).otherwise(F.col("so")).alias("sim"))
    return y.groupBy("j").agg(F.max(F.struct("sim", (-F.col("i")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("i"), "j", F.col("b.sim").alias("sim"))


def conicity(vectors: DataFrame) -> DataFrame:
    """One row: mean and population variance of the cosine-like alignment to the mean vector."""
    mean = vectors.select(F.posexplode("vec").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m")).agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("ms")).select(F.transform("ms", lambda x: x.m).alias("mean"))
    atm = vectors.join(F.broadcast(mean)).select((dot("vec", "mean") / norm("mean")).alias("atm"))
    return atm.agg(F.round(F.avg("atm"), 6).alias("conicity"), F.round(F.var_pop("atm"), 6).alias("spread"))


def hyperplane_codes(vectors: DataFrame, planes: list[list[float]]) -> DataFrame:
    """(id, code): the signs of the products with fixed planes."""
    bits = [F.when(dot("vec", F.array(*[F.lit(float(x)) for x in p])) >= 0, "1").otherwise("0") for p in planes]
    return vectors.select("id", F.concat(*bits).alias("code"))
