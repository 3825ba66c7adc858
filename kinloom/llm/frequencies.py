"""How often every term sequence occurs, in how many records, and which are too rare or too common: suffix-sorted counting.

Each record's term sequence gives its suffixes, cut at ``longest`` terms; equal suffixes of a record are summed before
anything moves. Suffixes are routed by their first term - by their whole text where a first term is hot, so that no task
gets a large share of the rows - and sorted in reverse lexicographic order within the tasks. A suffix then comes before
its prefixes, and one pass with a stack as deep as the longest suffix yields count and records of every prefix, all
n-grams that is, as soon as the order leaves it. An n-gram that several tasks saw, or whose records fill more than
CHUNK places, comes out in parts, which are added up at the end; its records are then counted exactly, apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.skew import hot_keys, in_list

RARE_BELOW = 20
COMMON_ABOVE = 0.75
CHUNK = 10_000
# Joins the terms of a suffix; sorts before every character of a term.
JOINT = "\x01"


def _stacked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n-grams with count and records from (suffix, record, n) rows in reverse lexicographic order of the suffix."""
    terms: list[str] = []
    counts: list[int] = []
    records: list[set] = []
    out: list[tuple] = []

    def leave(depth: int) -> None:
        while len(terms) > depth:
            gram, n, own = JOINT.join(terms), counts.pop(), records.pop()
            out.append((gram, n, list(own)))
            terms.pop()
            if counts:
                counts[-1] += n
                records[-1] |= own
                if len(records[-1]) > CHUNK:
                    out.append((JOINT.join(terms), 0, list(records[-1])))
                    records[-1].clear()

    for part in parts:
        for suffix, record, n in zip(part.suffix, part.record, part.n):
            new = suffix.split(JOINT)
            same = 0
            while same < min(len(new), len(terms)) and new[same] == terms[same]:
                same += 1
            leave(same)
            for t in new[same:]:
                terms.append(t)
                counts.append(0)
                records.append(set())
            counts[-1] += int(n)
            records[-1].add(record)
            if len(records[-1]) > CHUNK:
                out.append((JOINT.join(terms), 0, list(records[-1])))
                records[-1].clear()
        if len(out) > 5000:
            yield pd.DataFrame(out, columns=["gram", "n", "records"])
            out.clear()
    leave(0)
    yield pd.DataFrame(out, columns=["gram", "n", "records"])


def sequence_counts(rows: DataFrame, terms: str, record: str, weight: str, longest: int) -> DataFrame:
    """(gram array<string>, total, n_records): every run of up to ``longest`` terms, its summed weight and its records.

    ``terms`` is an array of strings without JOINT; null or empty arrays and null terms give nothing, a null record is one
    record of its own, a null weight counts 0. Other columns are ignored.
    """
    clean = rows.select(F.filter(terms, lambda t: t.isNotNull()).alias("ts"), F.coalesce(F.col(record).cast("string"), F.lit("\x00")).alias("record"), F.coalesce(F.col(weight), F.lit(0)).cast("bigint").alias("n")).where("size(ts) > 0")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("ts")), lambda i: F.array_join(F.slice("ts", i, F.lit(longest)), JOINT))
    moved = clean.select(F.explode(suffixes).alias("suffix"), "record", "n").groupBy("suffix", "record").agg(F.sum("n").alias("n"))
    first = F.substring_index("suffix", JOINT, 1)
    hot = hot_keys(moved.select(first.alias("first")), "first")
    routed = moved.withColumn("route", F.when(in_list(first, hot), F.col("suffix")).otherwise(first))
    grams = routed.repartition("route").sortWithinPartitions(F.desc("suffix")).select("suffix", "record", "n").mapInPandas(_stacked, "gram string, n bigint, records array<string>")
    parts = grams.groupBy("gram").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("parts"), F.max(F.size("records")).alias("n_records"))
    split = grams.join(parts.where("parts > 1").select("gram"), "gram", "left_semi").select("gram", F.explode("records").alias("r")).distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("exact"))
    return parts.join(split, "gram", "left").select(F.split("gram", JOINT).alias("gram"), "total", F.coalesce("exact", F.col("n_records").cast("bigint")).alias("n_records"))


def key_frequencies(rows: DataFrame, key: Column, spelled: str, file: str, count: str, sent_at: str,
                    rare: int = RARE_BELOW, common: float = COMMON_ABOVE) -> DataFrame:
    """(key, total, n_files, mark): mark is rare, common or null; keys are sequences of one term.

    A row sent again (same file, spelling, count and time) counts once. Null and negative counts add nothing, though
    the key itself stays; a file holds a key if it has any row of it. The share is of all files in ``rows``.
    """
    once = rows.select(F.col(file).alias("file"), F.col(spelled).alias("spelled"), F.col(count).alias("n"), F.col(sent_at).alias("at"), key.alias("key")).distinct()
    terms = once.where("key is not null and file is not null").select(F.array("key").alias("terms"), "file", F.when(F.col("n") >= 0, F.col("n")).otherwise(F.lit(0)).alias("n"))
    totals = sequence_counts(terms, "terms", "file", "n", 1).select(F.col("gram")[0].alias("key"), "total", F.col("n_records").alias("n_files"))
    files = rows.agg(F.countDistinct(file).alias("_files"))
    mark = F.when(F.col("total") < rare, "rare").when(F.col("n_files") > common * F.col("_files"), "common")
    return totals.join(F.broadcast(files)).select("key", "total", "n_files", mark.alias("mark"))
