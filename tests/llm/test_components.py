import pytest

from kinloom.llm.components import connected_groups

LINKS = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(30)] + [("a", "b"), ("b", "a"), ("a", "b"), ("d", "d"), ("e", None), (None, "f"), (None, None)]


def plain(links):
    """Smallest record of the group of each record, by relabelling until nothing changes."""
    key = {x: x for pair in links for x in pair if x is not None}
    changed = True
    while changed:
        changed = False
        for x, y in links:
            if x is not None and y is not None and key[x] != key[y]:
                key[x] = key[y] = min(key[x], key[y])
                changed = True
    return key


@pytest.mark.parametrize("small", [0, 2_000])
def test_groups_are_those_of_a_plain_search(spark, small):
    df = spark.createDataFrame([(x, y, "z") for x, y in LINKS], "x string, y string, record string")
    rows = connected_groups(spark, df, "x", "y", small=small).collect()
    assert len(rows) == len({r.record for r in rows})
    assert {r.record: r.group_key for r in rows} == plain(LINKS)


def test_small_graph_is_finished_at_once(spark, monkeypatch):
    from kinloom.llm import components

    def fail(*_):
        raise AssertionError("a level for a small graph")

    monkeypatch.setattr(components, "_grow", fail)
    df = spark.createDataFrame(LINKS, "x string, y string")
    assert {r.record: r.group_key for r in connected_groups(spark, df, "x", "y").collect()} == plain(LINKS)
