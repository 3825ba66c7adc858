"""Key linking of arriving dump lines: parsed, keyed, joined to a static table of keys, each pair once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.names import literal_text, record_name, schema_term
from kinloom.operators.linking import MIN_LENGTH, normalize_key
from kinloom.operators.rejects import load_statements


def link_stream(lines: DataFrame, keys: DataFrame, term: str, least: int = MIN_LENGTH, late: str = "1 hour") -> DataFrame:
    """(e1, e2, at): statements of ``term`` in a stream of (at timestamp, line) whose value is a key (entity, value).

    A pair that comes again within ``late`` of event time is dropped; state older than that is forgotten.
    """
    rows = load_statements(lines.select(F.to_json(F.struct("at")).alias("id"), "line"), "id", "line").where("reason is null")
    named = rows.where(schema_term(F.col("p")) == term).select(F.from_json("id", "at timestamp")["at"].alias("at"), record_name(F.col("s")).alias("e1"), normalize_key(literal_text(F.col("o"))).alias("key"))
    static = keys.select(F.col("entity").alias("e2"), normalize_key("value").alias("key")).where(F.length("key") >= least).distinct()
    return named.where(F.length("key") >= least).withWatermark("at", late).join(static, "key").dropDuplicatesWithinWatermark(["e1", "e2"]).select("e1", "e2", "at")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything the source holds now, appended to ``path``; the checkpoint folder remembers what has been read."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line) of a folder into which Parquet files of (line, loaded_at) arrive."""
    return spark.readStream.schema("line string, loaded_at timestamp").parquet(path).select(F.col("loaded_at").alias("at"), "line")
