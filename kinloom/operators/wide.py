"""Attribute triples as key-value maps of typed cells, and as one row for each subject.

Each triple's value is read as its column's type; equal cells of a subject are counted before anything else moves. A
subject's resolved pairs then become one map from column to cells, with the values that couldn't be cast kept beside
them; the known columns are projected from the map. A subject with a large share of the rows has its map in up to SALTS
parts, which the projection puts together by combining minima and sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.cells import cell_column
from kinloom.functions.names import record_name, record_name_of, schema_term
from kinloom.operators.skew import hot_keys, in_list

SALTS = 256


def resolved_pairs(triples: DataFrame, catalog: DataFrame) -> DataFrame:
    """(h, salt, col_name, cell, n, text): cells of each subject and column with how often they are given; cell is null
    for values that have none of the column's type, text is then the smallest of these."""
    columns = catalog.select(schema_term(F.col("prop")).alias("term"), "col_name", "col_type", "unit")
    # a subject is hot if one of its spellings is
    hot = [n for h in hot_keys(triples, "h") if (n := record_name_of(h))]
    rows = triples.where("h is not null and t is not null").select(record_name(F.col("h")).alias("h"), schema_term(F.col("r")).alias("term"), "t")
    read = rows.where("h is not null").join(F.broadcast(columns), "term").select("h", "col_name", "t", cell_column("col_name", "col_type", "unit", "t").alias("cell"))
    salt = F.when(in_list(F.col("h"), hot), F.pmod(F.xxhash64("cell"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    failed = F.when(F.col("cell").isNull(), F.col("t"))
    return read.withColumn("salt", salt).groupBy("h", "salt", "col_name", "cell").agg(F.count(F.lit(1)).alias("n"), F.min(failed).alias("text"))


def entity_maps(pairs: DataFrame) -> DataFrame:
    """(h, salt, cells): map from column to an array of (cell, n, text)."""
    by_column = pairs.groupBy("h", "salt", "col_name").agg(F.collect_list(F.struct("cell", "n", "text")).alias("own"))
    return by_column.groupBy("h", "salt").agg(F.map_from_entries(F.collect_list(F.struct("col_name", "own"))).alias("cells"))


def typed_cells(triples: DataFrame, catalog: DataFrame) -> DataFrame:
    """(h, col_name, cell): the distinct cells of each subject, from its map."""
    maps = entity_maps(resolved_pairs(triples, catalog).where("cell is not null"))
    return maps.select("h", F.explode("cells").alias("col_name", "own")).select("h", "col_name", F.explode("own.cell").alias("cell"))


def _more(c: str) -> Column:
    return F.greatest(F.lit(0), F.coalesce(F.col(f"{c}_n"), F.lit(0)) - 1).cast("bigint")


def wide_rows(triples: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row for each subject with, for each property, a typed column: the value given most often, the smallest of equals;
    ``<column>_more``: how many further values there are; ``<column>_failed``: a value that couldn't be cast, null if none.
    Subjects without any value have null columns."""
    columns = [(r.col_name, r.col_type) for r in catalog.orderBy("col_name").collect()]
    maps = entity_maps(resolved_pairs(triples, catalog))
    own = lambda c: F.col("cells")[c]
    good = lambda c: F.filter(own(c), lambda x: x["cell"].isNotNull())
    best = lambda c: F.array_min(F.transform(good(c), lambda x: F.struct((-x["n"]).alias("m"), x["cell"].alias("cell"))))
    parts = [x for c, _ in columns for x in (best(c).alias(f"{c}_b"), F.greatest(F.size(good(c)), F.lit(0)).alias(f"{c}_n"), F.array_min(F.transform(own(c), lambda x: x["text"])).alias(f"{c}_f"))]
    joined = maps.select("h", *parts).groupBy("h").agg(*[x for c, _ in columns for x in (F.min(f"{c}_b").alias(f"{c}_b"), F.sum(f"{c}_n").alias(f"{c}_n"), F.min(f"{c}_f").alias(f"{c}_f"))])
    subjects = triples.select(record_name(F.col("h")).alias("h")).where("h is not null").distinct()
    out = [x for c, kind in columns for x in (F.col(f"{c}_b.cell").cast(kind).alias(c), _more(c).alias(f"{c}_more"), F.col(f"{c}_f").alias(f"{c}_failed"))]
    return subjects.join(joined, "h", "left").select("h", *out)
