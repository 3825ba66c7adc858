def test_p2_found(spark, tmp_path):
    from kinloom.plans.catalog import queries

    rows = [(1, "_:a <u:p> <u:o> ."), (2, "broken"), (3, None), (4, " # c"), (5, '_:a <u:p> "2023-02-29"^^<http://www.w3.example/2001/XMLSchema#date> .')]
    spark.createDataFrame(rows, "line_id bigint, line string").write.parquet(f"{tmp_path}/parse_nq_or_nt.parquet")
    assert sorted(r.line_id for r in queries()["p2_found"](spark, str(tmp_path)).collect()) == [2, 5]


def test_cells():
    from kinloom.functions.cells import cell

    cases = [
        ("duration", "bigint", "second", {'"PT7M36S"': "456", '"P0DT0H3M20S"': "200", '"4:35"': "275", '"00:05:47"': "347", '"2 min 54 s"': "174", '"414 sec"@en': "414", "187": "187", '"PT"': None, '"live"': None, '""': None}),
        ("date_published", "date", None, {'"21/04/1972"': "1972-04-21", '"11/16/1984"@en': "1984-11-16", '"05/06/1984"': None, '"5/5/1984"': "1984-05-05", '"20.02.2000"@de': "2000-02-20", '"19660924"': "1966-09-24",
         '"1969-01-27 10:15"': "1969-01-27", '"30 aug 1985"': "1985-08-30", '"February 23, 1982"': "1982-02-23", '"1966-07-21T00:00:00Z"': "1966-07-21", '"2001-02-30"': None, '"1998-04"': None, "2016": None, '"November 1961"@en': None}),
        ("number_of_pages", "bigint", None, {'"pp. 300"': "300", '"260 S."@de': "260", '"504 p."': "504", '"630.0"': "630", '"66-74"': None, '"TBD"': None, '"1.5"': None}),
        ("num_tracks", "bigint", None, {'"Tracks: 5"@en': "5", '"6 tracks"': "6", '" 3 "': "3"}),
        ("elevation", "bigint", "metre", {'"2252m"': "2252", '"551 metres"@en': "551", '"1250 ft"': "381", '"1000 ft"': None, '"1,234"': "1234", '"-3 m"': "-3"}),
        ("rating_value", "decimal(3,1)", None, {'"4"': "4.0", '"4.60"': "4.6", '"1,0"@de': "1.0", '"3.8 out of 5"@en': "3.8", '"1.7/5"': "1.7", '"★★★★"': "4.0", '"4 or 5"': None, '"1.25"': None, '"?"@en': None}),
        ("is_family_friendly", "boolean", None, {'"Y"': "true", '"no"@en': "false", '"http://schema.example/True"': "true", '"maybe"': None, '"0"': "false"}),
    ]
    for col, kind, unit, texts in cases:
        assert {t: cell(col, kind, unit, t) for t in texts} == texts


def test_wide_rows(spark):
    from kinloom.operators.wide import typed_cells, wide_rows

    catalog = spark.createDataFrame([("http://schema.example/numTracks", "num_tracks", "bigint", None), ("http://schema.example/name", "name", "string", None)], "prop string, col_name string, col_type string, unit string")
    rows = [("_:a", "schema:numtracks", '"7"'), ("_:a", "<https://schema.example/numTracks/>", "7"), ("_:a", "http://schema.example/numTracks", '"3"'), ("_:b", "schema:name", '"x"@en'), (None, "schema:name", '"y"'), ("_:c", "schema:name", None)]
    df = spark.createDataFrame(rows, "h string, r string, t string")
    assert {tuple(r) for r in typed_cells(df, catalog).distinct().collect()} == {("_:a", "num_tracks", "7"), ("_:a", "num_tracks", "3"), ("_:b", "name", "x")}
    got = {r.h: (r.num_tracks, r.num_tracks_more, r.num_tracks_failed, r.name) for r in wide_rows(df.union(spark.createDataFrame([("_:c", "schema:numTracks", "many")], df.schema)), catalog).collect()}
    assert got == {"_:a": (7, 1, None, None), "_:b": (None, 0, None, "x"), "_:c": (None, 0, "many", None)}
    assert typed_cells(df.limit(0), catalog).collect() == [] and wide_rows(df.limit(0), catalog).collect() == []


def test_a_hot_subject_in_two_spellings(spark):
    from kinloom.operators.wide import typed_cells, wide_rows

    catalog = spark.createDataFrame([("http://schema.example/numTracks", "num_tracks", "bigint", None)], "prop string, col_name string, col_type string, unit string")
    df = spark.createDataFrame([("_:hub" if i % 3 else " <_:hub> ", "schema:numTracks", str(i % 50)) for i in range(6000)], "h string, r string, t string")
    assert sorted(int(r.cell) for r in typed_cells(df, catalog).collect()) == list(range(50))
    assert [(r.h, r.num_tracks_more) for r in wide_rows(df, catalog).collect()] == [("_:hub", 49)]
