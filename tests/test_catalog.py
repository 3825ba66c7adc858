from kinloom.functions.statements import in_type, parse_line
from kinloom.operators.linking import key_link_exact, links_to_ids, mapping_ids


def test_entry_file_gives_queries_and_flagship(spark):
    import __spark_entry__ as e

    assert {"p2_found", "p5_found", "parse_quads", "key_link_coverage"} <= set(e.queries())
    assert isinstance(e.oracle_sql(), dict)
    row = e.entry(spark).collect()
    assert len(row) == 1 and row[0].n_keys > 0


def test_parse_line():
    x = "^^<http://www.w3.example/2001/XMLSchema#"
    good = ['_:b1 <http://s/n> "A \\"q\\" B"@en <http://g/1> .', '<http://x/e><http://x/p>"12"' + x + 'integer>.', "_:a <u:p> _:b. # c"]
    bad = ["garbage", "<rel> <http://x/p> <http://x/o> .", '_:a <u:p> "a\\q" .', '_:a <u:p> "a" . <u:x>', "_:a <u:p> <u:i i> .",
           '_:a <u:p> "2023-02-29"' + x + "date> .", '_:a <u:p> "1e5"' + x + "decimal> .", '_:a "p" _:b .', '_:a <u:p> 12 .']
    assert all(parse_line(s)[4] is None and parse_line(s)[0] for s in good)
    assert all(parse_line(s)[4] for s in bad)
    assert all(parse_line(s) == (None,) * 5 for s in [None, "", " \t", "  # c"])
    assert parse_line(good[0])[2] == '"A \\"q\\" B"@en'
    assert in_type("2024-02-29T24:00:00Z", "dateTime") and not in_type("1900-02-29", "date") and not in_type("True", "boolean")


def test_links_and_ids(spark):
    left = spark.createDataFrame([("a", "Éclair-1234"), ("a", "eclair 1234"), ("b", "short"), ("c", None)], "entity string, value string")
    right = spark.createDataFrame([("x", "ECLAIR 1234"), ("y", "short")], "entity string, value string")
    links = key_link_exact(left, right)
    assert [r[:2] for r in links.collect()] == [("a", "x")]
    one = spark.createDataFrame([(e,) for e in "aabc"], "element string")
    two = spark.createDataFrame([(e,) for e in "xy"], "element string")
    ids = mapping_ids(spark, one, two)
    assert {r.element: r.id for r in ids[0].collect()} == {"a": 0, "c": 2, "b": 4}
    assert {r.element: r.id for r in ids[1].collect()} == {"y": 1, "x": 3}
    assert [tuple(r) for r in links_to_ids(links, *ids).collect()] == [(0, 3)]
