import pytest
from pyspark.sql import functions as F

from kinloom.operators.names import common_length, mutual_best
from kinloom.sources import files


def put(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_triples_links_and_vectors(spark, tmp_path):
    rel = put(tmp_path / "rel", "a\tr\tb", "a\tr\tb", "c\tr\td")
    assert sorted(tuple(r) for r in files.read_relations(spark, rel).collect()) == [("a", "r", "b"), ("c", "r", "d")]
    with pytest.raises(Exception):
        files.read_relations(spark, put(tmp_path / "bad", "a\tr")).collect()
    attr = put(tmp_path / "attr", "a\tn\tx\ty...", "short\trow", "a\tn\tz")
    assert sorted(tuple(r) for r in files.read_attributes(spark, attr).collect()) == [("a", "n", "x y"), ("a", "n", "z")]
    links = put(tmp_path / "links", "a\tb", "a\tb", "c\td")
    assert [(r.e1, r.e2) for r in files.read_links(spark, links).orderBy("at").collect()] == [("a", "b"), ("a", "b"), ("c", "d")]
    table = put(tmp_path / "table", "Method\tWDC_IRI\tWikidata_URI", "m\ta\tb", "short")
    assert [tuple(r) for r in files.read_link_table(spark, table).collect()] == [("a", "b")]
    words = put(tmp_path / "vec", "2 3", "w 1.0 2.0 3.5")
    assert [(r.word, r.vec) for r in files.read_word_vectors(spark, words, 3).collect()] == [("w", [1.0, 2.0, 3.5])]


def test_reports_and_parts(spark, tmp_path):
    log = put(tmp_path / "log", "x", "accurate results: hits@[1 5] = [50.0 75.0]%, mr = 3.250, mrr = 0.611", "accurate results: hits@[1 5] = [1 2]%, mr = 9, mrr = 9")
    assert [(r.mr, r.mrr) for r in files.scan_metrics(spark, log).collect()] == [(3.25, .611)]
    report = put(tmp_path / "report", "key: 1\t2")
    assert [(r.key, r["at"], r.value) for r in files.read_report(spark, report).collect()] == [("key", 0, "1"), ("key", 1, "2")]
    assert files.parts_of("0-2,5", [0, 1, 2, 3, 5]) == [0, 1, 2, 5] and files.parts_of("all", [3, 1]) == [1, 3]
    df = spark.createDataFrame([("_:a", "u:b")], "e1 string, e2 string")
    assert files.same_as(df).first()[0] == "_:a <http://www.w3.org/2002/07/owl#sameAs> <u:b> ."


def test_alignment_xml(spark, tmp_path):
    cell = '<map><Cell><entity1 rdf:resource="u:a"/><entity2 rdf:resource="u:b"/><measure rdf:datatype="f">1.0</measure><relation>=</relation></Cell></map>'
    path = put(tmp_path / "x.rdf", f'<rdf:RDF xmlns:rdf="r"><Alignment>{cell}{cell.replace("u:b", "u:c")}</Alignment></rdf:RDF>')
    assert sorted(tuple(r) for r in files.read_alignment_xml(spark, path).collect()) == [("u:a", "u:b", "1.0", "="), ("u:a", "u:c", "1.0", "=")]


def test_folder_reversed(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in (1, 2):
        put(tmp_path / f"rel_triples_{k}", f"h{k}\tr\tt")
        put(tmp_path / f"attr_triples_{k}", f"h{k}\ta\tv")
    for part in ("train", "valid", "test"):
        put(tmp_path / "d" / f"{part}_links", "h1\th2")
    got = files.read_folder(spark, str(tmp_path), "d", reverse=True)
    assert got["rel1"].first().h == "h2" and got["train"].select("e1", "e2").first() == ("h2", "h1")


def test_names(spark):
    assert common_length("abcbd", "abd") == 3
    one, two = spark.createDataFrame([("birth place",), ("name",)], "x string"), spark.createDataFrame([("place of birth",), ("full name",)], "y string")
    got = {(r.x, r.y) for r in mutual_best(one, two, 0.3).collect()}
    assert ("name", "full name") in got and ("birth place", "place of birth") in got
    assert mutual_best(one.where(F.lit(False)), two, 0.4).collect() == []
