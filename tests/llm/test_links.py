"""p1_found and p4_found against a plain search over small fixtures, in place of an SQL check."""

import pytest

from kinloom.llm.queries import p1_found, p4_found

E = "http://www.wikidata.example/entity/"
LINKS = [
    *[(i, f"_:c{i}", f"{E}Q{i // 2 + 1}") for i in range(1, 12)],  # chain by shared entities
    *[(20 + i, "_:hub", f"wd:q{500 + i}") for i in range(8)],  # star
    (40, "<_:x>", f"<{E}q77>"), (41, "_:x", "Q77"), (42, "_:y", "https://www.wikidata.example/wiki/Q77"),  # repeated, in spellings
    (50, None, f"{E}Q90"), (51, "_:lone", None), (52, " ", "n/a"), (53, None, None), (54, None, "Q90"),  # one-sided or missing
    (60, "HTTPS://A.example/p/", "Q91"), (61, "http://a.example/p", None),
]
NAMES = {"<_:x>": "_:x", "HTTPS://A.example/p/": "http://a.example/p", " ": None, "n/a": None}


def name(x):
    x = NAMES.get(x, x)
    tail = x.strip("<>").split("/")[-1].split(":")[-1].upper() if x else ""
    return E + tail if tail[:1] == "Q" and tail[1:].isdigit() else x


def groups(links):
    """Sets of link ids and records that belong together, merged one link at a time."""
    found = []
    for i, a, b in links:
        mine = ({i}, {x for x in (name(a), name(b)) if x})
        for g in [g for g in found if g[1] & mine[1]]:
            found.remove(g)
            mine = (mine[0] | g[0], mine[1] | g[1])
        found.append(mine)
    return found


@pytest.fixture(params=["full", "empty"])
def data(spark, tmp_path, request):
    links = LINKS if request.param == "full" else []
    spark.createDataFrame([(*x, "clash", "clash") for x in links], "link_id bigint, wdc_iri string, wikidata_uri string, record string, group_key string").write.parquet(f"{tmp_path}/read_links.parquet")
    spark.createDataFrame([("train", .7), ("test", .3)], "split_name string, share double").write.parquet(f"{tmp_path}/split_targets.parquet")
    return str(tmp_path), links


def test_p1_found(spark, data):
    got = sorted(tuple(r) for r in p1_found(spark, data[0]).select("record", "group_key").collect())
    assert got == sorted((x, min(g[1])) for g in groups(data[1]) for x in g[1])


def test_p4_found(spark, data):
    got = sorted(tuple(r) for r in p4_found(spark, data[0]).select("first_link_id", "link_id").collect())
    assert got == sorted((min(g[0]), i) for g in groups(data[1]) for i in g[0] if i != min(g[0]))
