from collections import Counter

from kinloom.llm.splits import grouped_splits

TARGETS = [("train", .7), ("test", .3)]


def test_every_row_comes_out_once_with_nulls_and_repeats(spark):
    rows = [(1, "a", "x"), (2, "a", None), (3, None, None), (3, None, None), (None, None, None), (None, None, None), (None, "b", None), (4, "a", "y"), (4, "a", "y")]
    df = spark.createDataFrame(rows, "id bigint, l string, r string")
    out = grouped_splits(spark, df, "id", "l", "r", TARGETS).collect()
    assert Counter(r.id for r in out) == Counter(r[0] for r in rows)
    assert len({r.split for r in out if r.id == 3}) == 1
    assert {r.first_id for r in out if r.id in (1, 2, 4)} == {1} and len({r.split for r in out if r.id in (1, 2, 4)}) == 1


def test_copies_without_record_count_as_one_group(spark):
    df = spark.createDataFrame([(i // 2, None, None) for i in range(400)], "id bigint, l string, r string")
    out = grouped_splits(spark, df, "id", "l", "r", TARGETS).collect()
    assert len(out) == 400 and all(n == 1 for n in Counter(i for i, _ in {(r.id, r.split) for r in out}).values())
    assert abs(sum(r.split == "train" for r in out) / 400 - .7) < .05


def report(spark, path, links, targets):
    from kinloom.llm.queries import p4_shares

    cols = "link_id bigint, wdc_iri string, wikidata_uri string"
    spark.createDataFrame(links, cols).write.parquet(f"{path}/read_links.parquet")
    spark.createDataFrame(targets, "split_name string, share double").write.parquet(f"{path}/split_targets.parquet")
    return {r.split_name: (r.target, r.n_rows, r.n_groups, r.reached) for r in p4_shares(spark, str(path)).collect()}


def test_shares_report_splits_without_rows(spark, tmp_path):
    links = [(i, "_:a", None) for i in range(5)]
    got = report(spark, tmp_path / "one", links, [("train", .8), ("test", .2), ("none", 0.0), ("null", None)])
    assert got == {"train": (.8, 5, 1, 1.0), "test": (.2, 0, 0, 0.0), "none": (0.0, 0, 0, 0.0), "null": (None, 0, 0, 0.0)}
    got = report(spark, tmp_path / "empty", [], [("train", .8), ("test", .2)])
    assert got == {"train": (.8, 0, 0, 0.0), "test": (.2, 0, 0, 0.0)}


def test_shares_without_any_positive_share(spark, tmp_path):
    assert report(spark, tmp_path, [(1, "_:a", None)], [("train", 0.0)]) == {"train": (0.0, 0, 0, 0.0)}
