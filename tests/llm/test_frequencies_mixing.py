from pyspark.sql import functions as F

from kinloom.functions.names import predicate_name
from kinloom.llm.frequencies import key_frequencies
from kinloom.llm.mixing import mix_documents, mix_shares


def test_key_frequencies(spark):
    rows = [("f1", "<http://x/A/>", 30, 1), ("f1", "<http://x/A/>", 30, 1), ("f2", "https://x/a", 5, 1), ("f3", "http://x/a", None, 1), ("f4", "http://x/a", -4, 1),
            ("f1", "http://x/b", 19, 1), ("f2", "http://x/c", None, 1), ("f1", "http://x/d", 20, 1)]
    df = spark.createDataFrame(rows, "file string, p string, n bigint, at bigint")
    got = {r.key: (r.total, r.n_files, r.mark) for r in key_frequencies(df, predicate_name(F.col("p")), "p", "file", "n", "at").collect()}
    assert got == {"http://x/a": (35, 4, "common"), "http://x/b": (19, 1, "rare"), "http://x/c": (0, 1, "rare"), "http://x/d": (20, 1, None)}
    assert key_frequencies(df.limit(0), predicate_name(F.col("p")), "p", "file", "n", "at").count() == 0


def test_mix(spark):
    docs = spark.createDataFrame([(i, "w " * 10, ["a-b", " A_B", "c"][i % 3]) for i in range(300)] + [(900, None, "c"), (901, "x", None)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "a_b", .5, 1, .4), ("m", "c", .5, 2, .4), ("n", "c", .8, 1, 2.0), ("n", "a_b", .2, 1, 2.0), ("n", "none", .1, 1, 2.0)],
                                    "mix_name string, source string, target_share double, max_repeats int, size_ratio double")
    mixed = mix_documents(spark, docs, targets)
    rows = mixed.collect()
    tokens = {r.doc_id: r.tokens for r in rows}
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    assert all(r.repeats <= (2 if (r.mix_name, r.source) == ("m", "c") else 1) for r in rows)
    got = {(r.mix_name, r.source): r for r in mix_shares(mixed, docs, targets).collect()}
    assert abs(got["m", "c"].share_reached - .5) < .02 and abs(got["m", "c"].size_reached - .4) < .02
    assert got["n", "c"].tokens == sum(n for i, n in tokens.items() if i % 3 == 2 and i < 300) and abs(got["n", "a_b"].share_reached - .2) < .02  # c can't fill .8 of 2.0, so the mix shrinks
    assert got["n", "none"].tokens == 0 and got["n", "none"].share_reached == 0
