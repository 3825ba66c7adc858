"""Joins that survive hot keys: a key holding a large part of the rows never meets a single task.

A key is hot when it holds more than 1/``parts`` of the rows, so at most ``parts`` keys can be hot: that bound is
what makes broadcasting their rows of the (unique-keyed) right side safe at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_PARTS = 500
HOT_LEAST = 1000


def hot_keys(df: DataFrame, key: str, parts: int = HOT_PARTS, least: int = HOT_LEAST) -> list:
    """Keys with more than max(rows/parts, least) rows; at most ``parts`` values. Counting combines map-side."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    big = counts.where(F.col("_n") > least)
    rows = big.orderBy(F.col("_n").desc()).limit(parts).collect()
    if not rows:
        return []
    total = df.count()
    return [r[0] for r in rows if r["_n"] * parts > total]


def in_list(col: Column, values: list) -> Column:
    return F.coalesce(col.isin(values), F.lit(False)) if values else F.lit(False)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``left`` (any number of rows a key) with ``right`` (one row a key); inner or left.

    Rows of hot keys meet a broadcast of the at most HOT_PARTS right rows of those keys, all others a shuffled join.
    Null keys match nothing, as in SQL.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = in_list(F.col(key), hot)
    return (
        left.where(~is_hot).join(right.where(~is_hot), key, how)
        .unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))
    )


BLOCK = 1000
PAIRS_A_TASK = 4_000_000


def block_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join where a key may have many rows on both sides: they meet in cells of about BLOCK times BLOCK rows.

    Tasks are counted by the pairs they give, as the rows that come in say nothing of them, and only about one row for BLOCK
    pairs is shuffled. Rows of either side should be distinct, since cells are told by their hash.
    """
    count = lambda df, n: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n))
    sizes = count(left, "_l").join(count(right, "_r"), key)
    pairs = sizes.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0.0
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, int(pairs / PAIRS_A_TASK)))
    blocks = sizes.select(key, F.ceil(F.col("_l") / BLOCK).alias("_is"), F.ceil(F.col("_r") / BLOCK).alias("_js"))

    def cells(df: DataFrame, own: str, other: str) -> DataFrame:
        salted = df.join(blocks, key).withColumn(own, F.pmod(F.xxhash64(*df.columns), F.col(f"{own}s")))
        return salted.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s") - 1))).select(*df.columns, "_i", "_j").repartition(parts, key, "_i", "_j")

    return cells(left, "_i", "_j").join(cells(right, "_j", "_i"), [key, "_i", "_j"]).drop("_i", "_j")
