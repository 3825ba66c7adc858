"""Mixes of documents: each source gets its share of the tokens, with whole repeats and a hash-ordered remainder.

The remainder is found by hash-threshold histograms: the tokens of each source are summed by bucket of the documents' hash,
the buckets below the budget are taken whole, and only the boundary bucket is split further, by the next bits, until it
holds one document. Documents below the threshold are then filtered; nothing is sorted. All mixes share the hash, so
that a smaller budget takes a part of what a larger one takes.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.session import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How that vocabulary cuts text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BITS, STEP = 60, 12


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(c: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text in a public byte-pair vocabulary; null counts 0."""
    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        e = _encoding(vocabulary)
        return texts.map(lambda x: len(e.encode_ordinary(x)) if isinstance(x, str) else 0).astype("int64")
    return count(c)


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, h): h is the place in the hash order, in [0, 2 ** BITS)."""
    return documents.select("doc_id", source_name(F.col("source")).alias("source"), token_count(F.col("text"), vocabulary).alias("tokens"), F.xxhash64("doc_id").bitwiseAND(F.lit((1 << BITS) - 1)).alias("h"))


def thresholds(spark: SparkSession, docs: DataFrame, budgets: dict[tuple[str, str], float]) -> dict[tuple[str, str], int]:
    """For each (mix, source) the hash below which its documents fit the budget, short by less than one document."""
    lows, rest, open_ = dict.fromkeys(budgets, 0), dict(budgets), set(budgets)
    for shift in range(BITS - STEP, -1, -STEP):
        if not open_:
            break
        ranges = F.broadcast(spark.createDataFrame([(m, s, lows[m, s]) for m, s in sorted(open_)], "mix_name string, source string, low bigint"))
        rows = docs.join(ranges, "source").where((F.col("h") >= F.col("low")) & (F.shiftright(F.col("h") - F.col("low"), shift) < (1 << STEP)))
        sums = rows.groupBy("mix_name", "source", F.shiftright(F.col("h") - F.col("low"), shift).alias("bucket")).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
        of: dict[tuple[str, str], list] = {}
        for r in sums:
            of.setdefault((r.mix_name, r.source), []).append((r.bucket, r.n, r.docs))
        for key in list(open_):
            low, edge = lows[key], None
            for bucket, n, k in sorted(of.get(key, [])):
                if n > rest[key]:
                    edge = (bucket, k)
                    break
                rest[key] -= n
                low = lows[key] + ((bucket + 1) << shift)
            if edge is None:
                lows[key] = lows[key] + (1 << (shift + STEP))
                open_.discard(key)
            else:
                lows[key] = lows[key] + (edge[0] << shift)
                if edge[1] == 1:
                    open_.discard(key)
    return lows


def mix_documents(spark: SparkSession, documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(mix_name, source, doc_id, tokens, repeats > 0): documents of each mix and how often each is used.

    A mix has size_ratio times the tokens of all documents, or less where a source, used max_repeats times, can't fill
    its share of that: then the whole mix shrinks so that the shares hold. A source without tokens gives nothing and
    shrinks nothing. The remainder over whole repeats goes to documents in hash order, short by less than one document.
    The targets are a list for people, read to the driver.
    """
    scratch = Scratch(spark, "mix")
    docs = scratch.write(sized(documents, vocabulary))
    wanted = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats", "size_ratio").where("target_share > 0 and max_repeats > 0")
    have = docs.groupBy("source").agg(F.sum("tokens").alias("have")).where("have > 0")
    total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).first()["total"]
    ask = F.col("target_share") * F.col("size_ratio") * F.lit(total)
    plan = (wanted.join(have, "source").withColumn("ask", ask)
            .withColumn("fit", F.least(F.lit(1.0), F.min(F.col("max_repeats") * F.col("have") / F.col("ask")).over(Window.partitionBy("mix_name"))))
            .withColumn("need", F.col("ask") * F.col("fit"))
            .withColumn("whole", F.least(F.floor(F.col("need") / F.col("have") + 1e-9), F.col("max_repeats").cast("bigint")))
            .withColumn("rest", F.when(F.col("whole") < F.col("max_repeats"), F.greatest(F.lit(0.0), F.col("need") - F.col("whole") * F.col("have"))).otherwise(F.lit(0.0)))
            .select("mix_name", "source", "whole", "rest").collect())
    cut = thresholds(spark, docs, {(r.mix_name, r.source): r.rest for r in plan if r.rest > 0})
    rules = spark.createDataFrame([(r.mix_name, r.source, r.whole, cut.get((r.mix_name, r.source), 0)) for r in plan], "mix_name string, source string, whole bigint, cut bigint")
    used = docs.where("tokens > 0").join(F.broadcast(rules), "source").withColumn("repeats", F.col("whole") + (F.col("h") < F.col("cut")).cast("bigint"))
    return used.where("repeats > 0").select("mix_name", "source", "doc_id", "tokens", "repeats")


def mix_shares(mixed: DataFrame, documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each target: tokens, share and size reached beside those asked for; 0 where nothing came."""
    tokens = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n"))
    total = documents.select(token_count(F.col("text"), vocabulary).alias("t")).agg(F.sum("t").alias("total"))
    asked = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "size_ratio")
    x = (asked.join(tokens, ["mix_name", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
         .withColumn("mix", F.sum("n").over(Window.partitionBy("mix_name"))).join(F.broadcast(total)))
    share = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return x.select("mix_name", "source", "target_share", share("n", "mix").alias("share_reached"), F.col("n").alias("tokens"),
                    "size_ratio", share("mix", "total").alias("size_reached"))
