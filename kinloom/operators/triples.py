"""Filters, counts and rewrites of triples (h, r, t), attribute triples (e, a, v) and links (e1, e2)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.skew import block_join
from kinloom.session import Scratch


def count_of(alias: str):
    return F.count(F.lit(1)).alias(alias)


def squeezed(text: str) -> str:
    return re.sub("[^a-z0-9]", "", text.lower())


# filters

def predicate_pattern(triples: DataFrame, pattern: str) -> DataFrame:
    """Triples whose predicate, in lower case without other signs, contains the pattern treated alike."""
    return triples.where(F.regexp_replace(F.lower("r"), "[^a-z0-9]", "").contains(squeezed(pattern)))


def predicate_histogram(triples: DataFrame, top: int) -> DataFrame:
    """(r, n): the most frequent predicates; ties by name."""
    return triples.groupBy("r").agg(count_of("n")).orderBy(F.desc("n"), "r").limit(top)


def of_type(triples: DataFrame, type_term: str, cls: str) -> DataFrame:
    """All triples of the subjects typed ``cls``."""
    return triples.join(triples.where((F.col("r") == type_term) & (F.col("t") == cls)).select("h").distinct(), "h", "left_semi")


def without_predicates(triples: DataFrame, exact: list[str] = (), parts: list[str] = ()) -> DataFrame:
    """Without predicates of a set, or holding one of some lower-case parts."""
    out = triples.where(~F.col("r").isin(list(exact))) if exact else triples
    return out.where(~F.lower("r").rlike("|".join(re.escape(p) for p in parts))) if parts else out


def mask_values(attributes: DataFrame, values: DataFrame) -> DataFrame:
    """Without attribute triples whose value is one of ``values`` (column v): what links give away."""
    return attributes.join(values.select("v").distinct(), "v", "left_anti").select("e", "a", "v")


def min_predicate_count(triples: DataFrame, least: int) -> DataFrame:
    common = triples.groupBy("r").agg(count_of("n")).where(F.col("n") >= least).select("r")
    return triples.join(common, "r", "left_semi").select("h", "r", "t")


def property_frequency(triples: DataFrame, labels: DataFrame, most: int, denied: list[str], kept: list[str]) -> DataFrame:
    """Drops predicates with a denied label, and those of at most ``most`` triples unless their label is kept."""
    counts = triples.groupBy("r").agg(count_of("n")).join(labels, "r", "left")
    label = F.coalesce("label", F.lit(""))
    gone = counts.where(label.isin(denied) | ((F.col("n") <= most) & ~label.isin(kept))).select("r")
    return triples.join(gone, "r", "left_anti").select("h", "r", "t")


def min_entity_triples(links: DataFrame, triples: DataFrame, least: int) -> DataFrame:
    """Links whose e1 is the head of at least ``least`` triples."""
    counts = triples.groupBy(F.col("h").alias("e1")).agg(count_of("n"))
    return links.join(counts, "e1", "left").where(F.coalesce("n", F.lit(0)) >= least).select("e1", "e2")


def both_ends_in(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples with both ends among ``entities`` (column e)."""
    e = entities.select("e").distinct()
    return triples.join(e.withColumnRenamed("e", "h"), "h", "left_semi").join(e.withColumnRenamed("e", "t"), "t", "left_semi").select("h", "r", "t")


def ends(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("h", "t")).alias("e")).distinct()


def links_with_triples(links: DataFrame, triples1: DataFrame, triples2: DataFrame) -> DataFrame:
    """Distinct links with both entities in the triples of their graph."""
    x = links.join(ends(triples1).withColumnRenamed("e", "e1"), "e1", "left_semi")
    return x.join(ends(triples2).withColumnRenamed("e", "e2"), "e2", "left_semi").select("e1", "e2").distinct()


def prune_to_links(scratch: Scratch, links: DataFrame, triples1: DataFrame, triples2: DataFrame, most_rounds: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """both_ends_in and links_with_triples in turn until the sizes stay; every round is written to the shared folder."""
    sizes = None
    for _ in range(most_rounds):
        links = scratch.write(links_with_triples(links, triples1, triples2))
        triples1 = scratch.write(both_ends_in(triples1, links.select(F.col("e1").alias("e"))))
        triples2 = scratch.write(both_ends_in(triples2, links.select(F.col("e2").alias("e"))))
        now = (links.count(), triples1.count(), triples2.count())
        if now == sizes:
            break
        sizes = now
    return links, triples1, triples2


def head_reachable(triples: DataFrame) -> DataFrame:
    """Triples whose tail is a head as well."""
    return triples.join(triples.select(F.col("h").alias("t")).distinct(), "t", "left_semi").select("h", "r", "t")


def clear_attributes(attributes: DataFrame, least: int = 10) -> DataFrame:
    """(e, a, v, is_number) of attributes with at least ``least`` triples: quotes, tags, datatypes and signs gone, links out."""
    common = attributes.groupBy("a").agg(count_of("n")).where(F.col("n") >= least).select("a")
    bare = F.regexp_replace(F.regexp_replace("v", r'\^\^.*$|@[A-Za-z-]+$', ""), r'^"+|"+$', "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[.(),_\-\"]", " "), r"\s+", " "))
    x = attributes.join(common, "a", "left_semi").where(~F.lower("v").contains("http")).select("e", "a", clean.alias("v"), bare.alias("_b"))
    return x.where("v <> ''").select("e", "a", "v", F.expr("try_cast(_b as double) is not null").alias("is_number"))


def popular_attributes(attributes: DataFrame, share: float) -> DataFrame:
    """(a, n): the int(share * number) attributes with most triples; ties by name."""
    counts = attributes.groupBy("a").agg(count_of("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "a"))).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.where(F.col("k") <= F.floor(F.col("all") * share)).select("a", "n")


def attribute_onehot(attributes: DataFrame, share: float = 0.7) -> DataFrame:
    """(e, idx, val): 1.0 for each attribute of an entity among the top share by number of entities; sparse."""
    counts = attributes.groupBy("a").agg(F.countDistinct("e").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "a"))).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy()))
    top = ranked.where(F.col("k") <= F.floor(F.col("all") * share)).select("a", (F.col("k") - 1).cast("bigint").alias("idx"))
    return attributes.select("e", "a").distinct().join(top, "a").select("e", "idx", F.lit(1.0).alias("val"))


def language_filter(attributes: DataFrame, lang: str) -> DataFrame:
    """Untagged literals and those tagged ``lang``."""
    return attributes.where(F.regexp_extract("v", r'"@([A-Za-z-]+)$', 1).isin("", lang))


def first_description(attributes: DataFrame, part: str = "escription") -> DataFrame:
    """(e, v): the smallest value of an attribute whose name holds ``part``, one an entity."""
    return attributes.where(F.col("a").contains(part)).groupBy("e").agg(F.min("v").alias("v"))


def attr_rel_split(triples: DataFrame) -> DataFrame:
    """(h, r, t, kind): attr for quoted objects, rel for others."""
    return triples.select("h", "r", "t", F.when(F.col("t").startswith('"'), "attr").otherwise("rel").alias("kind"))


# joins and rewrites

def merge_map(keys: DataFrame) -> DataFrame:
    """(e, target): entities (e, key) that share a key go to the smallest of them; the smallest target of several keys."""
    least = keys.groupBy("key").agg(F.min("e").alias("target"))
    return keys.join(least, "key").groupBy("e").agg(F.min("target").alias("target")).where("e <> target")


def apply_merge(triples: DataFrame, merge: DataFrame) -> DataFrame:
    """Heads and tails replaced by their targets, exactly, never inside longer names."""
    x = triples.join(merge.select(F.col("e").alias("h"), F.col("target").alias("th")), "h", "left").join(merge.select(F.col("e").alias("t"), F.col("target").alias("tt")), "t", "left")
    return x.select(F.coalesce("th", "h").alias("h"), "r", F.coalesce("tt", "t").alias("t"))


def prefix_links(left: DataFrame, right: DataFrame, least: int = 8) -> DataFrame:
    """(e1, e2, min_len): keys (e, key) of at least ``least`` characters, one a proper prefix of the other.

    An equal join on the first ``least`` characters with the rest as a residual; prefixes that many keys share are
    spread over the right side's longer key, so that no group of pairs has to meet in one task.
    """
    a = left.where(F.length("key") >= least).select(F.col("e").alias("e1"), F.col("key").alias("k1"))
    b = right.where(F.length("key") >= least).select(F.col("e").alias("e2"), F.col("key").alias("k2"))
    at = lambda c: F.substring(c, 1, least)
    x = a.withColumn("p", at("k1")).join(b.withColumn("p", at("k2")), "p").where("k1 <> k2 and (startswith(k1, k2) or startswith(k2, k1))")
    return x.groupBy("e1", "e2").agg(F.min(F.least(F.length("k1"), F.length("k2"))).alias("min_len"))


def swap_relations(links: DataFrame, triples: DataFrame, frm: str, to: str) -> DataFrame:
    """Triples of the linked entities ``frm`` copied onto their partners ``to``, in both places; distinct."""
    m = links.select(F.col(frm).alias("x"), F.col(to).alias("y"))
    heads = triples.join(m, triples.h == m.x).select(F.col("y").alias("h"), "r", "t")
    tails = triples.join(m, triples.t == m.x).select("h", "r", F.col("y").alias("t"))
    return heads.unionByName(tails).distinct()


def swap_attributes(links: DataFrame, attributes: DataFrame, frm: str, to: str) -> DataFrame:
    m = links.select(F.col(frm).alias("x"), F.col(to).alias("y"))
    return attributes.join(m, attributes.e == m.x).select(F.col("y").alias("e"), "a", "v").distinct()


def enhance(links: DataFrame, triples1: DataFrame, triples2: DataFrame) -> DataFrame:
    """Edges of graph 1 with both ends linked, as edges of graph 2 that it lacks."""
    m = links.select("e1", "e2").distinct()
    x = triples1.join(m.select(F.col("e1").alias("h"), F.col("e2").alias("h2")), "h").join(m.select(F.col("e1").alias("t"), F.col("e2").alias("t2")), "t")
    mapped = x.select(F.col("h2").alias("h"), F.col("r"), F.col("t2").alias("t")).distinct()
    return mapped.join(triples2.select("h", "t").distinct(), ["h", "t"], "left_anti").select("h", "r", "t")


def expand(links: DataFrame, triples: DataFrame) -> DataFrame:
    """Triples with heads and tails replaced by their counterparts in every combination; distinct."""
    m = links.select(F.col("e1").alias("x"), F.col("e2").alias("y")).unionByName(links.select(F.col("e2").alias("x"), F.col("e1").alias("y"))).distinct()
    x = triples.join(m.select(F.col("x").alias("h"), F.col("y").alias("hy")), "h", "left").join(m.select(F.col("x").alias("t"), F.col("y").alias("ty")), "t", "left")
    forms = F.array(*[F.struct(a.alias("h"), F.col("r").alias("r"), b.alias("t")) for a in (F.col("h"), F.col("hy")) for b in (F.col("t"), F.col("ty"))])
    return x.select(F.explode(forms).alias("f")).select("f.*").where("h is not null and t is not null").distinct()


def predicate_swap(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """(h, r, t, w): predicates replaced by their aligned ones (p1, p2, w)."""
    return triples.join(pairs, triples.r == pairs.p1).select("h", F.col("p2").alias("r"), "t", "w")


def weighted(triples: DataFrame, pairs: DataFrame, default: float = 0.2, low: float = 0.5) -> DataFrame:
    """(h, r, t, w): the zoomed weight of an aligned predicate, or the default."""
    least = pairs.agg(F.min("w").alias("m"))
    zoom = 1 - (1 - F.col("w")) * (1 - low) / (1 - F.col("m"))
    rows = triples.join(F.broadcast(pairs.join(F.broadcast(least)).select(F.col("p1").alias("r"), zoom.alias("z"))), "r", "left")
    return rows.select("h", "r", "t", F.coalesce("z", F.lit(default)).alias("w"))


def two_step_paths(triples: DataFrame, limit: int = 101) -> DataFrame:
    """(rx, ry, r, w): two-step paths closed by an edge, with the product of their fan-outs below ``limit``; a bag."""
    fan = triples.groupBy("h", "r").agg(count_of("n"))
    legs = triples.join(fan.where(F.col("n") < limit), ["h", "r"])
    x, y = legs.select(F.col("h").alias("hx"), F.col("r").alias("rx"), F.col("t").alias("m"), F.col("n").alias("nx")), legs.select(F.col("h").alias("m"), F.col("r").alias("ry"), F.col("t").alias("ty"), F.col("n").alias("ny"))
    p = x.join(y, "m").where(F.col("nx") * F.col("ny") < limit)
    return p.join(triples.select(F.col("h").alias("hx"), "r", F.col("t").alias("ty")), ["hx", "ty"]).select("rx", "ry", "r", (F.col("nx") * F.col("ny")).alias("w"))


def two_hop_patterns(triples: DataFrame, skip: int = 5) -> DataFrame:
    """(h, pattern, t): two-hop pairs without a direct edge, of all but the ``skip`` most frequent predicate pairs."""
    x, y = triples.select("h", F.col("r").alias("rx"), F.col("t").alias("m")), triples.select(F.col("h").alias("m"), F.col("r").alias("ry"), "t")
    hops = x.join(y, "m").where("h <> t").join(triples.select("h", "t").distinct(), ["h", "t"], "left_anti")
    counts = hops.groupBy("rx", "ry").agg(count_of("n")).withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "rx", "ry"))).where(F.col("k") > skip)
    return hops.join(F.broadcast(counts.select("rx", "ry")), ["rx", "ry"]).select("h", F.concat_ws("+", "rx", "ry").alias("pattern"), "t").distinct()


# features

def degrees(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("h", "t")).alias("e")).groupBy("e").agg(count_of("deg"))


def pair_degree_buckets(links: DataFrame, deg1: DataFrame, deg2: DataFrame, bounds: list[int]) -> DataFrame:
    """(bucket, n): links by the interval their mean degree falls into; the last bound is open."""
    x = links.join(deg1.select(F.col("e").alias("e1"), F.col("deg").alias("d1")), "e1", "left").join(deg2.select(F.col("e").alias("e2"), F.col("deg").alias("d2")), "e2", "left")
    mean = (F.coalesce("d1", F.lit(0)) + F.coalesce("d2", F.lit(0))) / 2
    bucket = F.lit(0)
    for i, b in enumerate(bounds):
        bucket = F.when(mean >= b, i + 1).otherwise(bucket)
    return x.groupBy(bucket.cast("bigint").alias("bucket")).agg(count_of("n"))


def functionality(triples: DataFrame) -> DataFrame:
    """(r, fun, ifun): distinct heads, and distinct tails, over triples."""
    return triples.groupBy("r").agg((F.countDistinct("h") / F.count(F.lit(1))).alias("fun"), (F.countDistinct("t") / F.count(F.lit(1))).alias("ifun"))


def weighted_adjacency(triples: DataFrame, floor: float = 0.3) -> DataFrame:
    """(a, b, w): summed inverse functionality along an edge and functionality against it, self-loops skipped."""
    x = triples.where("h <> t").join(F.broadcast(functionality(triples)), "r")
    fwd, back = x.select(F.col("h").alias("a"), F.col("t").alias("b"), F.greatest("ifun", F.lit(floor)).alias("w")), x.select(F.col("t").alias("a"), F.col("h").alias("b"), F.greatest("fun", F.lit(floor)).alias("w"))
    return fwd.unionByName(back).groupBy("a", "b").agg(F.sum("w").alias("w"))


def one_hop(triples: DataFrame) -> DataFrame:
    """(a, b): distinct undirected neighbours, both ways."""
    e = triples.where("h <> t").select(F.col("h").alias("a"), F.col("t").alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


WIDEST = 1000


def two_hop(triples: DataFrame) -> DataFrame:
    """(a, b): neighbours of neighbours that are neither neighbours nor the same.

    Only a neighbour that has others leads on. Nodes with the same such neighbours are one kind: they reach the same nodes and
    each other, and two kinds that meet are neighbours in all their members or in none. So kinds are paired, each told by its
    first member, and their members last: those pairs don't repeat, and are written as they are formed. The sets of nodes with
    more than WIDEST such neighbours aren't compared; each of them is a kind of its own.
    """
    scratch = Scratch(triples.sparkSession, "two-hop")
    n = scratch.write(one_hop(triples))
    ways = scratch.write(n.join(n.groupBy("b").agg(count_of("d")).where("d > 1").select("b"), "b", "left_semi").select("a", F.col("b").alias("m")))
    widths = ways.groupBy("a").agg(count_of("d"))
    sets = ways.join(widths.where(F.col("d") <= WIDEST).select("a"), "a", "left_semi").groupBy("a").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    kinds = sets.groupBy("ms").agg(F.min("a").alias("k"), count_of("w"))
    wide = widths.where(F.col("d") > WIDEST).select("a", F.col("a").alias("k"), F.lit(1).cast("bigint").alias("w"))
    members = scratch.write(sets.join(kinds, "ms").select("a", "k", "w").unionByName(wide))
    ends = scratch.write(ways.join(members.where("a = k").select("a", "w"), "a"))

    other = lambda x: x.withColumnsRenamed({"a": "b", "w": "v"})
    apart = lambda x: x.select("a", "w", "b", "v").distinct().join(n, ["a", "b"], "left_anti")
    one, more = ends.where("w = 1"), ends.where("w > 1")
    single = apart(block_join(one, other(one), "m").where("a <> b"))
    # the members of the smaller kind of a pair are looked up first, those of the larger one meet them in cells
    met = scratch.write(apart(block_join(more, other(ends), "m").unionByName(block_join(one, other(more), "m"))).select(F.when(F.col("w") > F.col("v"), F.col("b")).otherwise(F.col("a")).alias("few"), F.when(F.col("w") > F.col("v"), F.col("a")).otherwise(F.col("b")).alias("k"), (F.col("w") > F.col("v")).alias("turned")))
    first = members.select(F.col("a").alias("x"), F.col("k").alias("few")).join(met, "few").select("x", "k", "turned")
    pairs = block_join(first, members.select(F.col("a").alias("y"), "k"), "k").where("x <> y")
    return single.select("a", "b").unionByName(pairs.select(F.when(F.col("turned"), F.col("y")).otherwise(F.col("x")).alias("a"), F.when(F.col("turned"), F.col("x")).otherwise(F.col("y")).alias("b")))


def with_loops(adjacency: DataFrame) -> DataFrame:
    """(a, b, w) with a self-loop of weight 1 on every node."""
    nodes = adjacency.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    return adjacency.unionByName(nodes.select("a", F.col("a").alias("b"), F.lit(1.0).alias("w")))


def normalized(adjacency: DataFrame) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 of (a, b, w)."""
    x = with_loops(adjacency)
    d = x.groupBy("a").agg(F.sum("w").alias("d"))
    y = x.join(d, "a").join(d.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    return y.select("a", "b", F.when((F.col("d") > 0) & (F.col("db") > 0), F.col("w") / F.sqrt("d") / F.sqrt("db")).otherwise(0.0).alias("w"))


def row_normalized(adjacency: DataFrame) -> DataFrame:
    d = adjacency.groupBy("a").agg(F.sum("w").alias("d"))
    return adjacency.join(d, "a").select("a", "b", (F.col("w") / F.col("d")).alias("w"))


def top_relations(triples: DataFrame, top: int) -> DataFrame:
    """(idx, h, t): edges of the relations with most edges, by rank; ties by name."""
    ranked = triples.groupBy("r").agg(count_of("n")).withColumn("idx", (F.row_number().over(Window.orderBy(F.desc("n"), "r")) - 1).cast("bigint")).where(F.col("idx") < top)
    return triples.join(F.broadcast(ranked.select("r", "idx")), "r").select("idx", "h", "t")


def incidence(triples: DataFrame) -> DataFrame:
    """(r, e, role): distinct heads and tails of each relation."""
    return triples.select("r", F.col("h").alias("e"), F.lit("head").alias("role")).unionByName(triples.select("r", F.col("t").alias("e"), F.lit("tail").alias("role"))).distinct()


def degree_graph(triples: DataFrame) -> DataFrame:
    """(h, t, w): distinct edges weighted 1 / sqrt(d_h) / sqrt(d_t), degrees starting at 1."""
    d = degrees(triples).select("e", (F.col("deg") + 1).alias("d"))
    x = triples.where("h <> t").select("h", "t").distinct().join(d.withColumnRenamed("e", "h").withColumnRenamed("d", "dh"), "h").join(d.withColumnRenamed("e", "t").withColumnRenamed("d", "dt"), "t")
    return x.select("h", "t", (1 / F.sqrt("dh") / F.sqrt("dt")).alias("w"))


def cooccurrence(attributes: DataFrame) -> DataFrame:
    """(a1, a2, n): pairs of attributes and the entities that have both."""
    x = attributes.select("e", "a").distinct()
    return x.withColumnRenamed("a", "a1").join(x.withColumnRenamed("a", "a2"), "e").where("a1 < a2").groupBy("a1", "a2").agg(count_of("n"))


def triple_weights(triples: DataFrame) -> DataFrame:
    """(h, r, t, w): 2 if the tail is a head with at most the mean number of triples, rounded up, else 1."""
    heads = triples.groupBy("h").agg(count_of("n"))
    mean = heads.agg(F.ceil(F.avg("n")).alias("m"))
    x = triples.join(heads.select(F.col("h").alias("t"), "n"), "t", "left").join(F.broadcast(mean))
    return x.select("h", "r", "t", F.when(F.col("n") <= F.col("m"), 2).otherwise(1).cast("bigint").alias("w"))


def bfs(scratch: Scratch, triples: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Triples of the seeds (column e) and of what they lead to in up to ``depth`` further steps; negative: until nothing is new."""
    frontier, seen, out, step = seeds.select("e").distinct(), seeds.select("e").distinct(), None, 0
    while depth < 0 or step <= depth:
        found = scratch.write(triples.join(frontier.withColumnRenamed("e", "h"), "h", "left_semi").select("h", "r", "t"))
        out = found if out is None else out.unionByName(found)
        if step == depth:
            break
        frontier = scratch.write(found.select(F.col("t").alias("e")).distinct().join(seen, "e", "left_anti"))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
        step += 1
    return out


def closure(scratch: Scratch, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(e): the roots and everything that reaches them over edges (sub, sup)."""
    seen = frontier = scratch.write(roots.select("e").distinct())
    while True:
        frontier = scratch.write(edges.join(frontier.withColumnRenamed("e", "sup"), "sup").select(F.col("sub").alias("e")).distinct().join(seen, "e", "left_anti"))
        if not frontier.take(1):
            return seen
        seen = seen.unionByName(frontier)


def folds(links: DataFrame, n: int = 5, train: float = 0.7, valid: float = 0.2) -> DataFrame:
    """(fold, e1, e2, part): each distinct link once a fold, in the order of a hash, cut at the shares."""
    x = links.select("e1", "e2").distinct().withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(1, n + 1)]))).withColumn("at", F.md5(F.concat_ws("|", "fold", "e1", "e2")))
    # places are counted by bucket of the hash, so that no task orders a whole fold
    x = x.withColumn("bucket", F.substring("at", 1, 3))
    sizes = x.groupBy("fold", "bucket").agg(count_of("own"))
    before = F.sum("own").over(Window.partitionBy("fold").orderBy("bucket")) - F.col("own")
    sizes = sizes.withColumn("before", before).withColumn("n", F.sum("own").over(Window.partitionBy("fold")))
    y = x.join(F.broadcast(sizes), ["fold", "bucket"]).withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("fold", "bucket").orderBy("at", "e1", "e2")))
    cut1, cut2 = F.floor(F.col("n") * train), F.floor(F.col("n") * train) + F.floor(F.col("n") * valid)
    return y.select(F.col("fold").cast("bigint").alias("fold"), "e1", "e2", F.when(F.col("k") <= cut1, "train").when(F.col("k") <= cut2, "valid").otherwise("test").alias("part"))


def negatives(triples: DataFrame, entities: DataFrame, per_triple: int, tries: int = 10) -> DataFrame:
    """(h, r, t, nh, nt): up to ``per_triple`` corruptions of head or tail by hash-drawn entities (idx, e), never existing triples."""
    n = entities.count()
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", "h", "r", "t", i)), 1, 8), 16, 10).cast("bigint")
    x = triples.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_triple * tries - 1)))).withColumn("d", draw(F.col("i")))
    x = x.withColumn("idx", F.floor(F.col("d") / 2) % n).join(entities, "idx")
    x = x.select("h", "r", "t", "i", F.when(F.col("d") % 2 == 0, F.col("e")).otherwise(F.col("h")).alias("nh"), F.when(F.col("d") % 2 == 0, F.col("t")).otherwise(F.col("e")).alias("nt"))
    fresh = x.join(triples.select(F.col("h").alias("nh"), "r", F.col("t").alias("nt")).distinct(), ["nh", "r", "nt"], "left_anti")
    k = F.row_number().over(Window.partitionBy("h", "r", "t").orderBy("i"))
    return fresh.withColumn("k", k).where(F.col("k") <= per_triple).select("h", "r", "t", "nh", "nt")


def chebyshev(adjacency: DataFrame, order: int, largest: float = 2.0) -> list[DataFrame]:
    """(a, b, w) of the Chebyshev polynomials T0 to T``order`` of the rescaled Laplacian 2 / largest * (I - A') - I, where A'
    is the symmetrically normalised adjacency without loops; ``largest`` is the greatest eigenvalue, at most 2."""
    d = adjacency.groupBy("a").agg(F.sum("w").alias("d"))
    eye = d.select("a", F.col("a").alias("b"), F.lit(1.0).alias("w"))
    off = adjacency.join(d, "a").join(d.select(F.col("a").alias("b"), F.col("d").alias("db")), "b").select("a", "b", (-F.lit(2.0 / largest) * F.col("w") / F.sqrt("d") / F.sqrt("db")).alias("w"))
    diagonal = 2.0 / largest - 1.0
    lap = off if diagonal == 0 else off.unionByName(eye.withColumn("w", F.lit(diagonal)))
    out = [eye, lap]
    while len(out) <= order:
        x = lap.select("a", F.col("b").alias("m"), "w").join(out[-1].select(F.col("a").alias("m"), "b", F.col("w").alias("v")), "m").select("a", "b", (2 * F.col("w") * F.col("v")).alias("w"))
        out.append(x.unionByName(out[-2].withColumn("w", -F.col("w"))).groupBy("a", "b").agg(F.sum("w").alias("w")))
    return out[:order + 1]


def enriched(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """(uri, label): every name in the triples with its label (uri, label), null if it has none."""
    return triples.select(F.explode(F.array("h", "r", "t")).alias("uri")).distinct().join(labels, "uri", "left")
