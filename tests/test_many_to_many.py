"""Joins of hot keys on both sides: the right rows, with a few of them shuffled."""

import random

from kinloom.operators import names
from kinloom.operators import triples as t3
from kinloom.plans import surveyed
from kinloom.plans.views import Views


def shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


PAIRS = [("label", "name"), ("label", "title"), ("brand", "maker"), ("size", "size")]


def plain(one, two, least):
    own, facts = {}, {}
    for e, a, v in one:
        for a1, a2 in PAIRS:
            if a == a1 and e is not None:
                own.setdefault(e, {}).setdefault(a1, set()).add((a2, v and v.lower()))
    for e, a, v in two:
        facts.setdefault(e, set()).add((a, v and v.lower()))
    out = set()
    for e1, by in own.items():
        for e2, f in facts.items():
            n = sum(any(x in f and x[1] is not None for x in values) for values in by.values())
            if n and n / len(by) > least:
                out.add((e1, e2, round(n / len(by), 6)))
    return out


def test_mediated_equals_all_pairs(spark):
    draw = random.Random(7)
    some = lambda attributes, letter: [(f"{letter}{draw.randrange(60)}" if draw.random() < 0.98 else None, draw.choice(attributes), draw.choice(["A", "a", "b", "c", "", None])) for _ in range(250)]
    one, two = some(["label", "brand", "size", "other"], "x"), some(["name", "title", "maker", "size"], "y")
    frames = [spark.createDataFrame(rows, "e string, a string, v string") for rows in (one, two)]
    pairs = spark.createDataFrame(PAIRS, "a1 string, a2 string")
    for least in (0.0, 0.5, 0.9):
        got = [tuple(r) for r in names.mediated(*frames, pairs, least, 6).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(one, two, least)
    assert names.mediated(*frames, pairs.limit(0), 0.5).collect() == []


def test_a_common_value_forms_no_pairs_alone(spark):
    """coalign_entities shuffled each pair with an equal brand, though pairs with only that are no result."""
    rows = spark.range(1500).selectExpr("concat('p', id) e", "inline(array(struct('label' a, concat('name ', id) v), struct('brand' a, 'same' v)))")
    before = shuffled(spark)
    pairs = spark.createDataFrame([("label", "label"), ("brand", "brand")], "a1 string, a2 string")
    got = names.mediated(rows, rows, pairs, 0.9, 6).collect()
    assert sorted((r.e1, r.e2, r.sim) for r in got) == sorted((f"p{i}", f"p{i}", 1.0) for i in range(1500))
    assert shuffled(spark) - before < 100_000


def test_hot_kinds_are_paired_in_cells(spark):
    rows = spark.range(1200).selectExpr("concat('p', id) e", "'brand' a", "'same' v")
    few = rows.where("e < 'p2'")
    got = names.mediated(rows, few, spark.createDataFrame([("brand", "brand")], "a1 string, a2 string"), 0.9)
    assert got.distinct().count() == got.count() == 1200 * few.count()


def test_two_hop_equals_all_paths(spark):
    draw = random.Random(3)
    rows = [(draw.choice([f"x{draw.randrange(25)}", f"y{draw.randrange(200)}", None]), "r", f"x{draw.randrange(25)}") for _ in range(150)]
    near = {(a, b) for h, _, t in rows if h and h != t for a, b in ((h, t), (t, h))}
    want = {(a, d) for a, b in near for c, d in near if b == c and a != d} - near
    got = [tuple(r) for r in t3.two_hop(spark.createDataFrame(rows, "h string, r string, t string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert t3.two_hop(spark.createDataFrame([], "h string, r string, t string")).collect() == []


def test_ends_of_a_star_are_not_shuffled_as_pairs(spark):
    """two_hop_neighbors shuffled every pair of nodes that share a neighbour, twice."""
    star = spark.range(1200).selectExpr("concat('c', id) h", "'r' r", "'n' t")
    before = shuffled(spark)
    assert len(t3.two_hop(star).collect()) == 1200 * 1199
    assert shuffled(spark) - before < 50_000


def paths(edges):
    near = {}
    for h, t in edges:
        if h and t and h != t:
            near.setdefault(h, set()).add(t)
            near.setdefault(t, set()).add(h)
    return {(a, c) for a in near for b in near[a] for c in near[b] - near[a] - {a}}


def test_two_hop_neighbors_takes_the_whole_graph(spark):
    """two_hop_neighbors left out the orders, the customers' regions and most customers."""
    folder = "/root/testdata/sf0.001"
    want = paths((r.h, r.t) for r in Views(spark, folder).rel1.collect())
    got = [(r.a, r.b) for r in surveyed.QUERIES["two_hop_neighbors"](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {a[0] for a, _ in got} == set("ocnr") and any(a > "c2" and a[0] == "c" for a, _ in got)


def test_two_hop_of_kinds_equals_all_paths(spark, monkeypatch):
    """Nodes that share all their neighbours, kinds that are neighbours, wide nodes, and ends of a single edge."""
    for seed, widest in ((1, 1000), (2, 1000), (3, 2), (4, 1)):
        monkeypatch.setattr(t3, "WIDEST", widest)
        draw = random.Random(seed)
        groups = [[f"{g}{i}" for i in range(draw.choice([1, 1, 2, 5]))] for g in "abcdefghij"]
        edges = [(x, y) for g in groups for h in groups if g is not h and draw.random() < 0.15 for x in g for y in h]
        edges += [(f"leaf{i}", draw.choice(groups)[0]) for i in range(30)] + [("lone", "pair"), ("self", "self"), ("self", "a0")]
        got = [(r.a, r.b) for r in t3.two_hop(spark.createDataFrame([(h, "r", t) for h, t in edges], "h string, r string, t string")).collect()]
        assert len(got) == len(set(got)) and set(got) == paths(edges)


def test_pairs_of_nodes_with_two_shared_neighbours_are_not_shuffled(spark):
    """the whole graph has customers with a nation and its region; each of their pairs was shuffled, for two neighbours."""
    rows = spark.range(1200).selectExpr("concat('c', id) h", "'r' r", "explode(array('n', 'r')) t")
    before = shuffled(spark)
    got = t3.two_hop(rows).collect()
    assert len(got) == len(set(got)) == 1200 * 1199 + 2
    assert shuffled(spark) - before < 50_000
