"""Graph files: triples, links, dictionaries, vectors, alignments and reports, read with fixed schemas and written alike.

Strict readers fail on a row with a wrong number of fields, lenient ones pass it over. Compressed files are read as they
are. Positions of links are kept, as they are the key of gold pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAB = "\t"


def _fields(spark: SparkSession, path: str, sep: str = TAB) -> DataFrame:
    return spark.read.text(path).where("value <> ''").select(F.split("value", sep).alias("f"), "value")


def _strict(rows: DataFrame, n: int) -> DataFrame:
    wrong = F.raise_error(F.concat(F.lit(f"{n} fields expected: "), "value"))
    return rows.withColumn("f", F.when(F.size("f") == n, F.col("f")).otherwise(wrong.cast("array<string>")))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """(h, r, t), distinct; strict."""
    f = F.col("f")
    return _strict(_fields(spark, path), 3).select(F.trim(f[0]).alias("h"), F.trim(f[1]).alias("r"), F.trim(f[2]).alias("t")).distinct()


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(e, a, v), distinct; short rows are passed over, further fields belong to the value, final dots go."""
    f = F.col("f")
    rows = _fields(spark, path).where("size(f) >= 3")
    value = F.regexp_replace(F.array_join(F.slice("f", 3, 1_000_000), " "), r"[.]+$", "")
    return rows.select(F.trim(f[0]).alias("e"), F.trim(f[1]).alias("a"), value.alias("v")).distinct()


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(at, e1, e2): every row; ``at`` rises with the place in the files. Strict."""
    f = F.col("f")
    return _strict(_fields(spark, path), 2).select(F.monotonically_increasing_id().alias("at"), f[0].alias("e1"), f[1].alias("e2"))


def read_link_table(spark: SparkSession, path: str, sep: str = TAB, columns: tuple[int, ...] = (0, 1), names: tuple[str, ...] = ("wdc_iri", "wikidata_uri")) -> DataFrame:
    """Links with more columns: a header is found by the names in it, else ``columns`` are taken; short rows are passed over."""
    rows = _fields(spark, path, sep)
    first = rows.limit(1).collect()
    head = [x.strip().lower().replace(" ", "") for x in first[0].f] if first else []
    at = [head.index(n) for n in names] if set(names) <= set(head) else list(columns)
    clean = rows.where(F.size("f") > max(at)).select(*[F.trim(F.col("f")[i]).alias(n) for i, n in zip(at, names)])
    return clean.where(F.regexp_replace(F.lower(names[0]), " ", "") != names[0]) if set(names) <= set(head) else clean


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(uri, id)."""
    f = F.col("f")
    return _strict(_fields(spark, path), 2).select(f[0].alias("uri"), f[1].cast("bigint").alias("id"))


def read_word_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(word, vec); a header and rows of another length are passed over."""
    f = F.col("f")
    return _fields(spark, path, " ").where(F.size("f") == dim + 1).select(f[0].alias("word"), F.transform(F.slice("f", 2, dim), lambda x: x.cast("double")).alias("vec"))


def read_folder(spark: SparkSession, path: str, division: str, reverse: bool = False) -> dict[str, DataFrame]:
    """The files of a graph pair; reversed, the graphs and the sides of every link change places."""
    one, two = (2, 1) if reverse else (1, 2)
    out = {f"rel{i}": read_relations(spark, f"{path}/rel_triples_{k}") for i, k in ((1, one), (2, two))}
    out |= {f"attr{i}": read_attributes(spark, f"{path}/attr_triples_{k}") for i, k in ((1, one), (2, two))}
    for part in ("train", "valid", "test"):
        links = read_links(spark, f"{path}/{division}/{part}_links")
        out[part] = links.select("at", F.col("e2").alias("e1"), F.col("e1").alias("e2")) if reverse else links
    return out


def read_alignment_xml(spark: SparkSession, path: str) -> DataFrame:
    """(entity1, entity2, measure, relation) of alignment cells."""
    rows = spark.read.format("xml").option("rowTag", "Cell").option("attributePrefix", "_").option("inferSchema", "false").load(path)
    at = lambda c: F.col(f"{c}.`_rdf:resource`")
    return rows.select(at("entity1").alias("entity1"), at("entity2").alias("entity2"), F.col("measure._VALUE" if "struct" in dict(rows.dtypes)["measure"] else "measure").alias("measure"), F.col("relation").alias("relation"))


def scan_metrics(spark: SparkSession, path: str, prefix: str = "accurate results") -> DataFrame:
    """(file, hits, mr, mrr) of the first line of each log that begins with ``prefix``."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value").where(F.trim("value").startswith(prefix))
    first = rows.groupBy("file").agg(F.min_by("value", "at").alias("line"))
    return first.select("file", F.regexp_extract("line", r"=\s*\[?([0-9. ]+)", 1).alias("hits"), F.regexp_extract("line", r"\bmr\s*=\s*([0-9.]+)", 1).cast("double").alias("mr"), F.regexp_extract("line", r"\bmrr\s*=\s*([0-9.]+)", 1).cast("double").alias("mrr"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(key, at, value) of lines "key: v<TAB>v"."""
    rows = spark.read.text(path).where(F.col("value").contains(":"))
    return rows.select(F.trim(F.substring_index("value", ":", 1)).alias("key"), F.posexplode(F.split(F.trim(F.expr("substring(value, instr(value, ':') + 1)")), TAB)).alias("at", "value"))


def parts_of(spec: str, known: list[int]) -> list[int]:
    """Numbers of a parts specification: "0-3", "0,2", "5" or "all"."""
    if spec.strip().lower() == "all":
        return sorted(known)
    wanted: set[int] = set()
    for x in spec.split(","):
        a, _, b = x.strip().partition("-")
        wanted |= set(range(int(a), int(b or a) + 1))
    return sorted(wanted & set(known))


def write_rows(rows: DataFrame, path: str) -> None:
    """Every column as text, tab separated, one row a line."""
    rows.select(F.concat_ws(TAB, *[F.col(c).cast("string") for c in rows.columns]).alias("value")).write.mode("overwrite").text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """"id v v ..." lines of (id, vec)."""
    vectors.select(F.concat_ws(" ", F.col("id").cast("string"), F.transform("vec", lambda x: x.cast("string"))).alias("value")).write.mode("overwrite").text(path)


def same_as(links: DataFrame, predicate: str = "http://www.w3.org/2002/07/owl#sameAs") -> DataFrame:
    """(value): an N-Triples line for each link; blank nodes stay bare."""
    term = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    return links.select(F.concat_ws(" ", term("e1"), F.lit(f"<{predicate}>"), term("e2"), F.lit(".")).alias("value"))


def predicate_statistics(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """(predicate, count, label): the label given, or the last part of the predicate."""
    counts = triples.groupBy(F.col("r").alias("predicate")).agg(F.count(F.lit(1)).alias("count"))
    return counts.join(labels.select(F.col("r").alias("predicate"), "label"), "predicate", "left").select("predicate", "count", F.coalesce("label", F.element_at(F.split("predicate", "[/#]"), -1)).alias("label"))


def as_json(rows: DataFrame) -> DataFrame:
    """(value): each row as one JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
