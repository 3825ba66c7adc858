"""Queries of the training-data problems over the project's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.names import literal_text, predicate_name, record_name, schema_term
from kinloom.llm import abuse, canonical, leaks, matching
from kinloom.llm.components import connected_groups
from kinloom.llm.frequencies import key_frequencies, sequence_counts
from kinloom.llm.mixing import mix_documents, mix_shares, source_name
from kinloom.llm.splits import grouped_splits
from kinloom.session import table

def named_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "read_links").select(
        "link_id", record_name(F.col("wdc_iri")).alias("wdc"), record_name(F.col("wikidata_uri")).alias("wiki"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_groups(spark, named_links(spark, sf_dir), "wdc", "wiki")


W3, WEB, DIRECT = "http://www.w3.example/", "http://schema.example/", "http://www.wikidata.example/prop/direct/p"
GRAPH_1 = matching.Schema(
    facts={WEB + k: v for k, v in {"name": "N", "alternatename": "N", "datepublished": "D", "openingdate": "D", "duration": "U", "numberofpages": "P", "inalbum": "L",
                                   "byartist": "C", "author": "C", "publisher": "B", "addresslocality": "T", "latitude": "Y", "longitude": "X", "elevation": "E"}.items()},
    classes={"musicrecording": "recording", "book": "book", "airport": "airport"}, type_term=W3 + "1999/02/22-rdf-syntax-ns#type",
    makers=[WEB + "byartist", WEB + "author"], places=[WEB + "address"])
FACTS_2 = {W3 + "2000/01/rdf-schema#label": "N", W3 + "2004/02/skos/core#altlabel": "N"} | {
    DIRECT + k: v for k, v in {"90003": "D", "90004": "U", "90005": "L", "90007": "P", "90008": "B", "90020": "G", "90021": "E", "90023": "T"}.items()}
CLASS_LABELS = {"music": "recording", "book": "book", "airport": "airport"}


def graph_2(attributes: DataFrame) -> matching.Schema:
    """Its classes are entities: those labelled as one of CLASS_LABELS, a handful whatever the graph's size."""
    label = F.lower(F.trim(literal_text(F.col("t"))))
    # cheap first: few values hold such a word at all
    near = F.lower("t").rlike("|".join(CLASS_LABELS))
    rows = attributes.where(near & label.isin(list(CLASS_LABELS))).where((schema_term(F.col("r")) == W3 + "2000/01/rdf-schema#label")).select(record_name(F.col("h")).alias("h"), label.alias("label"))
    used = rows.where("h is not null").distinct().collect()
    return matching.Schema(facts=FACTS_2, classes={r.h: CLASS_LABELS[r.label] for r in used}, type_term=DIRECT + "90001", makers=[DIRECT + "90002"])


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every matching pair with its score and confidence."""
    a1, r1, a2, r2 = (table(spark, sf_dir, f"{kind}_triples_{g}").select("h", "r", "t") for g in (1, 2) for kind in ("attr", "rel"))
    return matching.match_entities(spark, a1, r1, GRAPH_1, a2, r2, graph_2(a2))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_matches(spark, sf_dir).select("h1", "h2")


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = [(r.split_name, float(r.share)) for r in table(spark, sf_dir, "split_targets").orderBy(F.desc("share"), "split_name").collect() if r.share and r.share > 0]
    return grouped_splits(spark, named_links(spark, sf_dir), "link_id", "wdc", "wiki", targets)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_rows(spark, sf_dir)
    return rows.where("group_key is not null and link_id <> first_id").select(F.col("first_id").alias("first_link_id"), "link_id")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups and share reached of each split of split_targets, beside its target; 0 where no row came."""
    alone = F.col("group_key").isNull()
    groups = F.countDistinct("group_key") + F.countDistinct(F.when(alone, F.col("first_id"))) + F.count(F.when(alone & F.col("first_id").isNull(), 1))
    rows = split_rows(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), groups.alias("n_groups"))
    total = rows.agg(F.sum("n_rows").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (table(spark, sf_dir, "split_targets").join(rows, F.col("split") == F.col("split_name"), "left").join(F.broadcast(total))
            .select("split_name", F.col("share").alias("target"), zero("n_rows"), zero("n_groups"), F.coalesce(F.col("n_rows") / F.col("total"), F.lit(0.0)).alias("reached")))


def p7_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, dump files and mark of every predicate."""
    rows = table(spark, sf_dir, "write_prop_stats")
    found = key_frequencies(rows, predicate_name(F.col("predicate")), "predicate", "dump_file", "count", "written_at")
    return found.withColumnRenamed("key", "predicate")


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed count and dump files of every run of up to three parts of the predicates' paths."""
    rows = table(spark, sf_dir, "write_prop_stats").select("dump_file", "predicate", "count", "written_at").distinct()
    parts = F.filter(F.split(F.regexp_replace(predicate_name(F.col("predicate")), "^http://", ""), "[/#]"), lambda x: x != "")
    runs = sequence_counts(rows.select(parts.alias("terms"), "dump_file", F.when(F.col("count") >= 0, F.col("count")).alias("n")), "terms", "dump_file", "n", 3)
    return runs.select(F.array_join("gram", "/").alias("path"), F.size("gram").alias("n_parts"), "total", F.col("n_records").alias("n_files"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_stats(spark, sf_dir).where("mark is not null").select("predicate", "mark")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, share and size each source reached in each mix, beside its target."""
    return mix_shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def _typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "read_links").select("link_id", F.expr("stack(2, 'wdc', wdc_value, 'wiki', wiki_value) as (side, value)"))
    return canonical.map_values(spark, rows.where(F.trim("value") != ""), "value", table(spark, sf_dir, "canonical_values"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed_values(spark, sf_dir).select("link_id", "side", F.coalesce("canon_id", F.lit(0)).cast("bigint").alias("canon_id"))


def p6_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that name no entry, and how often each is typed on each side."""
    return _typed_values(spark, sf_dir).where("canon_id is null").groupBy("side", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item and the number of documents it leaked into, 0 where none."""
    n = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "eval_items").select("item_id", "benchmark").join(n, "item_id", "left").select("item_id", "benchmark", F.coalesce("n", F.lit(0)).alias("n_docs"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scored_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "abuse_samples"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.flagged(p10_scores(spark, sf_dir))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents of each source with each category."""
    return abuse.source_rates(p10_scores(spark, sf_dir), table(spark, sf_dir, "documents"), source_name(F.col("source")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p4_found": p4_found, "p4_shares": p4_shares,
    "p3_found": p3_found, "p3_matches": p3_matches, "p6_found": p6_found, "p6_misses": p6_misses, "p8_found": p8_found, "p8_report": p8_report,
    "p7_found": p7_found, "p7_stats": p7_stats, "p7_paths": p7_paths, "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates,
}

_NAMED = r"""with o as (select distinct dump_file,predicate,count n,written_at from write_prop_stats where predicate is not null and dump_file is not null),
k as (select dump_file f,n,regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(predicate,'^[\s<]+',''),'[\s>]+$','')),'^https://','http://'),'/+$','') predicate from o),
g as (select predicate,coalesce(sum(n) filter (n>=0),0)::bigint total,count(distinct f) n_files from k group by predicate),
m as (select *,case when total<20 then 'rare' when n_files>0.75*(select count(distinct dump_file) from write_prop_stats) then 'common' end mark from g)"""

SQL: dict[str, str] = {
    "p7_stats": _NAMED + " select predicate,total,n_files,mark from m",
    "p7_found": _NAMED + " select predicate,mark from m where mark is not null",
}
