"""Queries of the surveyed operators over whole tables, the flagship among them, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.names import ENTITY_BASE, literal_text, record_name, schema_term
from kinloom.operators import linking
from kinloom.operators.rejects import load_statements
from kinloom.operators.wide import typed_cells, wide_rows
from kinloom.plans import surveyed
from kinloom.session import table

NAME_TERM = "http://schema.example/name"
LABEL_TERM = "http://www.w3.example/2000/01/rdf-schema#label"


def parse_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of parse_nq_or_nt that is neither blank nor a comment: its terms, or the reason it has none."""
    return load_statements(table(spark, sf_dir, "parse_nq_or_nt"), "line_id", "line")


def _graph_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(h, r, t) of the dump's statements about web records; graph 2 entities are the other side."""
    rows = parse_quads(spark, sf_dir).where("reason is null").select(record_name(F.col("s")).alias("h"), schema_term(F.col("p")).alias("r"), F.col("o").alias("t"))
    return rows.where(F.col("h").isNotNull() & ~F.col("h").startswith(ENTITY_BASE))


def _graph_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "attr_triples_2").select("h", "r", "t").unionByName(table(spark, sf_dir, "rel_triples_2").select("h", "r", "t"))
    return rows.select(record_name(F.col("h")).alias("h"), schema_term(F.col("r")).alias("r"), "t").where("h is not null")


def _values(rows: DataFrame, term: str) -> DataFrame:
    return rows.where(F.col("r") == term).select(F.col("h").alias("entity"), literal_text(F.col("t")).alias("value"))


def key_link_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the dump linked to the labels of graph 2."""
    return linking.key_link_exact(_values(_graph_1(spark, sf_dir), NAME_TERM), _values(_graph_2(spark, sf_dir), LABEL_TERM))


def _ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def elements(rows: DataFrame) -> DataFrame:
        tails = rows.where(F.trim("t").rlike(r"^(?:<|_:|https?://)")).select(record_name(F.col("t")).alias("element"))
        return rows.select(F.col("h").alias("element")).unionByName(tails)
    return linking.mapping_ids(spark, elements(_graph_1(spark, sf_dir)), elements(_graph_2(spark, sf_dir)))


def links_to_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.links_to_ids(key_link_exact(spark, sf_dir), *_ids(spark, sf_dir))


def key_link_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: graph 1 keys, those linked, their share (0 without keys), links, and links with ids on both sides."""
    names = _values(_graph_1(spark, sf_dir), NAME_TERM)
    keys = names.select(linking.normalize_key("value").alias("key")).where(F.length("key") >= linking.MIN_LENGTH).distinct()
    links = key_link_exact(spark, sf_dir)
    matched = links.select(linking.normalize_key("v1").alias("key")).distinct()
    return (keys.agg(F.count(F.lit(1)).alias("n_keys"))
            .join(F.broadcast(matched.agg(F.count(F.lit(1)).alias("n_matched"))))
            .withColumn("coverage", F.when(F.col("n_keys") > 0, F.col("n_matched") / F.col("n_keys")).otherwise(F.lit(0.0)))
            .join(F.broadcast(links.agg(F.count(F.lit(1)).alias("n_links"))))
            .join(F.broadcast(links_to_ids(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_id_links")))))


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded and rejected lines by reason; no reason: loaded."""
    return parse_quads(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))


FOUND_TYPES = ["bigint", "date", "boolean", "decimal(3,1)"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_quads(spark, sf_dir).where("reason is not null").select("line_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "prop_catalog").where(F.col("col_type").isin(FOUND_TYPES))
    return typed_cells(table(spark, sf_dir, "attr_triples_1"), catalog)


def p5_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_rows(table(spark, sf_dir, "attr_triples_1"), table(spark, sf_dir, "prop_catalog"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_link_coverage(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_reasons": p2_reasons, "p5_found": p5_found, "p5_wide": p5_wide, "parse_quads": parse_quads, "key_link_exact": key_link_exact, "links_to_ids": links_to_ids, "key_link_coverage": key_link_coverage} | surveyed.QUERIES


def oracle_sql() -> dict[str, str]:
    return surveyed.SQL
