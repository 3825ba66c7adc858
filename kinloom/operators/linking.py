"""Key links between two graphs, ids of their elements, and how much of the keys a linking covers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinloom.operators.skew import skew_join
from kinloom.session import Scratch

MIN_LENGTH = 8


@F.pandas_udf(StringType())
def normalize_key(text: pd.Series) -> pd.Series:
    """Lower case, NFKD without combining marks, only a-z and 0-9; null becomes ''."""
    def one(x):
        plain = unicodedata.normalize("NFKD", x.lower()) if isinstance(x, str) else ""
        return re.sub("[^a-z0-9]", "", "".join(c for c in plain if not unicodedata.combining(c)))
    return text.map(one).astype(object)


def key_link_exact(left: DataFrame, right: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """(e1, e2, v1, v2): pairs of (entity, value) rows with equal normalised value of at least ``least`` characters.

    Each pair once, with its smallest values.
    """
    a = left.select(F.col("entity").alias("e1"), F.col("value").alias("v1"), normalize_key("value").alias("key")).where(F.length("key") >= least).distinct()
    b = right.select(F.col("entity").alias("e2"), F.col("value").alias("v2"), normalize_key("value").alias("key")).where(F.length("key") >= least).distinct()
    return a.join(b, "key").groupBy("e1", "e2").agg(F.min(F.struct("v1", "v2")).alias("v")).select("e1", "e2", "v.v1", "v.v2")


def ranked(spark: SparkSession, elements: DataFrame, scratch: Scratch) -> DataFrame:
    """(element, rank): by occurrences, then name, both falling; ``elements`` has one row for each occurrence.

    The sort stays distributed: rows are numbered within sorted partitions and shifted by the sizes of those before.
    """
    counts = elements.where("element is not null").groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    rows = scratch.write(counts.orderBy(F.desc("n"), F.desc("element")).withColumn("m", F.monotonically_increasing_id()))
    place = rows.select("element", F.shiftright("m", 33).alias("part"), F.expr("m & 8589934591").alias("i"))
    offsets, total = [], 0
    for r in place.groupBy("part").count().orderBy("part").collect():
        offsets.append((r["part"], total))
        total += r["count"]
    shift = spark.createDataFrame(offsets, "part bigint, shift bigint")
    return place.join(F.broadcast(shift), "part").select("element", (F.col("i") + F.col("shift")).alias("rank"))


def mapping_ids(spark: SparkSession, elements1: DataFrame, elements2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(element, id) of both graphs: ranks interleaved 2i and 2i+1, the longer side's leftovers after those."""
    scratch = Scratch(spark, "ids")
    one, two = (scratch.write(ranked(spark, e, scratch)) for e in (elements1, elements2))
    least = min(one.count(), two.count())
    rest = F.col("rank") + F.lit(least)
    return tuple(e.select("element", F.when(F.col("rank") < least, 2 * F.col("rank") + side).otherwise(rest).alias("id")) for side, e in enumerate((one, two)))


def links_to_ids(links: DataFrame, ids1: DataFrame, ids2: DataFrame) -> DataFrame:
    """(id1, id2); a link with an element that has no id is dropped, as the reference does."""
    x = skew_join(links.select("e1", "e2"), ids1.select(F.col("element").alias("e1"), F.col("id").alias("id1")), "e1")
    return skew_join(x, ids2.select(F.col("element").alias("e2"), F.col("id").alias("id2")), "e2").select("id1", "id2")
