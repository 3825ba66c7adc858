from kinloom.llm.canonical import Dictionary, distance, map_values

ENTRIES = [(1, "Quiet Harbour Sound Works"), (2, "Saint Varestra"), (3, "Éditions Mirenum"), (4, "Kelostra & Sorvein Publishing House"), (5, "Silver Candle Recordings"), (6, "Port Belouko"), (7, "Bruutha University Press")]
CASES = {"quiet_harbour sound wroks": 1, "Works, Quiet Harbour Sound": 1, "Q. Harbour Sound Works Ltd": 1, "St. Varestra (city)": 2, "VARESTRA, SAINT": 2, "Ã‰ditions Mirenum": 3, "Kelostra and Sorvein Publ. Hse": 4,
         "Silver Candle": 5, "SilverCandleRecordingsGmbH": 5, "Pt Belouko, city of": 6, "Port Beluoko": 6, "P. Bruutha University": 7, "Silver Candle Tapes": 0, "n/a": 0, "Varestburg": 0, "12345": 0}


def plain(a, b):
    """Unweighted Damerau-Levenshtein distance."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_values_typed_in_many_ways(spark):
    rows = spark.createDataFrame([(i, v, "clash") for i, v in enumerate([*CASES, None, "  ", "Port Beluoko"])], "link_id bigint, value string, canon_name string")
    entries = spark.createDataFrame(ENTRIES + ENTRIES[:1] + [(None, "x"), (9, None)], "canon_id int, canon_name string")
    got = [(r.value, r.canon_id or 0) for r in map_values(spark, rows, "value", entries).select("value", "canon_id").collect()]
    assert len(got) == rows.count() and {v: c for v, c in got if v in CASES} == CASES
    assert {r.canon_id for r in map_values(spark, rows, "value", entries.limit(0)).collect()} == {None}
    assert map_values(spark, rows.limit(0), "value", entries).collect() == []


def test_no_entry_within_two_edits_is_missed():
    words = ["mirenholt", "varestra", "belouko", "sorveinar", "quiethar"]
    d = Dictionary([(i, w, 0) for i, w in enumerate(words)])
    for i, w in enumerate(words):
        for k in range(len(w)):
            for x in (w[:k] + w[k + 1:], w[:k] + "z" + w[k:], w[:k] + w[k + 1:k + 2] + w[k:k + 1] + w[k + 2:]):
                assert d.ranked(x)[0][2] == i, x
    assert all(distance(a, b, 9) <= plain(a, b) for a in words for b in words)
