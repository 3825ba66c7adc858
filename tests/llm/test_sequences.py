from collections import defaultdict

from pyspark.sql import functions as F

from kinloom.llm import frequencies
from kinloom.llm.frequencies import sequence_counts

ROWS = [(["a", "b", "a"], "r1", 2), (["a", "b"], "r2", 1), (["b", "a", "b"], "r1", 5), ([], "r3", 1), (None, "r3", 1), (["c", None], None, 3), (["a"], "r9", None)]


def brute(rows, longest):
    total, records = defaultdict(int), defaultdict(set)
    for terms, record, n in rows:
        ts = [t for t in terms or [] if t is not None]
        for i in range(len(ts)):
            for j in range(i + 1, min(len(ts), i + longest) + 1):
                total[tuple(ts[i:j])] += n or 0
                records[tuple(ts[i:j])].add(record)
    return {g: (total[g], len(records[g])) for g in total}


def test_sequences_match_plain_counting(spark, monkeypatch):
    df = spark.createDataFrame(ROWS + ROWS[:1], "t array<string>, r string, w bigint")
    for chunk in (10_000, 1):
        monkeypatch.setattr(frequencies, "CHUNK", chunk)
        for longest in (1, 2, 5):
            got = {tuple(r.gram): (r.total, r.n_records) for r in sequence_counts(df, "t", "r", "w", longest).collect()}
            assert got == brute(ROWS + ROWS[:1], longest)


def test_hot_first_term_and_empty_table(spark):
    rows = [(["x", str(i % 40)], str(i % 7), 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "t array<string>, r string, w bigint").repartition(6)
    got = {tuple(r.gram): (r.total, r.n_records) for r in sequence_counts(df, "t", "r", "w", 2).collect()}
    assert got == brute(rows, 2)
    assert sequence_counts(df.where(F.lit(False)), "t", "r", "w", 2).count() == 0
