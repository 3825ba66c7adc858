"""Matching the things of two graphs that share no key: collective graph linkage.

1. Profiles. The triples of interest become clean facts (kind, value): names, version marks, dates, numbers, makers. A
   record's distinct facts are kept as one text.
2. Candidate graph. Records that share an attribute key are linked, weighted by how rare the key is. A common key (more
   than RARE pairs) links nothing alone, as one common attribute can't make a match; it links records that share a
   second common key with it, whatever the number of such records.
3. Meta-blocking. A link stays if its weight is at least KEEP of the best of either end.
4. Attribute score. Each kind of fact that both ends have speaks for the pair or against it (`compared`); contradicting dates,
   lengths or version marks tell editions apart.
5. Propagation. Makers are neighbours: a pair of makers is similar if its names are or if the other works that link the two
   are likely matches. Scores are updated until no decision changes.

A pair is a match if its score reaches ACCEPT and is within MARGIN of the best of its first end. Confidence is the logistic
of the score over ACCEPT.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions.cells import as_date, as_seconds, as_whole, lexical
from kinloom.functions.names import record_name_of, schema_term_of
from kinloom.llm.words import folded, mended
from kinloom.session import Scratch

RARE = 100
KEEP = 0.35
ACCEPT = 4.0
MARGIN = 2.0
SPLIT = "\x1f"
# Words that tell a version from the work, and what shops add to names.
VERSION = re.compile(r"[(\[]([^)\]]*\b(?:live|session|illustrated|remix|acoustic|instrumental|demo|remaster\w*|revised|abridged|unplugged|edition|version|extended|deluxe)\b[^)\]]*)[)\]]|,\s*((?:revised|illustrated|abridged) edition)")
EXTRA = re.compile(r"\s*[(\[][^)\]]*(?:[)\]]|$)|\s+\|.*$|\s+\*\w+\*|\s+-\s+(?:single|ep|album)\b.*$|\bfeat\b.*$|\bft\b\..*$")
ARTICLES = {"the", "a", "an", "der", "die", "das", "le", "la", "les", "el"}


@dataclass
class Schema:
    """How the facts of one graph are spelled: kind of fact by predicate, classes by type value, predicates of relations."""

    facts: dict[str, str]
    classes: dict[str, str]
    type_term: str
    makers: list[str]
    places: list[str] = field(default_factory=list)


def flat(x: str) -> str:
    return " ".join(re.findall(r"[a-z0-9]+", folded(x).replace("&", " and ")))


def name_facts(x: str) -> list[tuple[str, str]]:
    low = folded(mended(x)).replace("_", " ")
    mark = VERSION.search(low)
    base = EXTRA.sub(" ", VERSION.sub(" ", low))
    cut = "…" in low or low.rstrip().endswith("...")
    words = [w for w in flat(base).split() if w not in ARTICLES]
    if not words:
        return []
    return [("N", " ".join(words) + ("…" if cut else "")), ("V", flat(mark[1] or mark[2]) if mark else "-")]


def maker_fact(x: str) -> str:
    """Given names first, surname last, in flat words."""
    low = EXTRA.sub(" ", folded(mended(x)).replace("_", " "))
    parts = [flat(p) for p in low.split(",")]
    return " ".join(p for p in (parts[1:] + parts[:1] if len(parts) == 2 else parts) if p)


def coordinate(x: str) -> str | None:
    try:
        return f"{float(x.replace(',', '.')):.4f}"
    except ValueError:
        return None


@lru_cache(maxsize=200_000)
def facts(kind: str, t: str) -> tuple[tuple[str, str], ...]:
    """Clean facts of one value; none if it can't be read."""
    x, tag = lexical(t)
    x = x.rstrip(" .") if kind in "NLCBT" else x
    if not x:
        return ()
    if kind == "N":
        return tuple(name_facts(x))
    if kind == "D":
        d = as_date(x, tag) or (m[0] if (m := re.fullmatch(r"[12][0-9]{3}(?:-(?:0[1-9]|1[0-2]))?", x)) else None)
        return (("D", d),) if d else ()
    if kind == "U":
        n = as_seconds(x, tag)
    elif kind == "P":
        n = as_whole(x, tag, "number_of_pages", None)
    elif kind == "E":
        n = as_whole(x, tag, "elevation", "metre")
    elif kind == "G":
        m = re.search(r"\(\s*(\S+)\s+(\S+)\s*\)", x)
        pair = [coordinate(v) for v in (m[1], m[2])] if m else [None]
        return (("X", pair[0]), ("Y", pair[1])) if all(pair) else ()
    elif kind in "XY":
        n = coordinate(x)
    elif kind == "C":
        n = maker_fact(x)
    else:
        n = " ".join(w for w in flat(EXTRA.sub(" ", folded(mended(x)).replace("_", " "))).split() if w not in ARTICLES)
    return ((kind, n),) if n else ()


def attribute_facts(attributes: DataFrame, schema: Schema) -> DataFrame:
    """(id, f): the clean facts of attribute triples, kind and value in one text; one map, nothing moves."""
    kinds = schema.facts

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, out = [], []
            for h, r, t in zip(part.h, part.r, part.t):
                if (kind := kinds.get(schema_term_of(r))) and (i := record_name_of(h)):
                    for k, v in facts(kind, t):
                        ids.append(i)
                        out.append(k + v)
            yield pd.DataFrame({"id": ids, "f": out}, dtype=object)

    return attributes.select("h", "r", "t").where("h is not null and r is not null and t is not null").mapInPandas(read, "id string, f string")


def relation_facts(relations: DataFrame, schema: Schema) -> DataFrame:
    """(id, role, o): K and the class of a typed record, C and a maker, T and a node that tells the place."""
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for h, r, t in zip(part.h, part.r, part.t):
                term = schema_term_of(r)
                role = "K" if term == schema.type_term else "C" if term in schema.makers else "T" if term in schema.places else None
                if role and (i := record_name_of(h)) and (o := record_name_of(t)):
                    if role == "K":
                        o = schema.classes.get(re.sub(r"^.*[/:#]", "", o).lower()) or schema.classes.get(o)
                    if o:
                        rows.append((i, role, o))
            yield pd.DataFrame(rows, columns=["id", "role", "o"], dtype=object)

    return relations.select("h", "r", "t").where("h is not null and r is not null and t is not null").mapInPandas(read, "id string, role string, o string")


def profiles(attributes: DataFrame, relations: DataFrame, schema: Schema, scratch: Scratch) -> DataFrame:
    """(id, cls, profile): the distinct facts of each record of a class in schema.classes, as one text."""
    own, rel = scratch.write(attribute_facts(attributes, schema)), scratch.write(relation_facts(relations, schema).distinct())
    # names of the makers, and places of the address nodes, behind a relation
    behind = rel.where("role <> 'K'").select("id", "role", F.col("o").alias("node"))
    named = own.where("f like 'N%' or f like 'T%'").select(F.col("id").alias("node"), F.col("f").alias("nf")).distinct()
    far = behind.join(named, "node", "left").where("role = 'C' and (nf is null or nf like 'N%') or role = 'T' and nf like 'T%'")
    told = F.when(F.col("role") == "T", F.col("nf")).otherwise(F.concat(F.lit("C"), F.coalesce(F.substring("nf", 2, 200), F.lit("")), F.lit("@"), F.col("node")))
    every = own.unionByName(far.select("id", told.alias("f"))).unionByName(rel.where("role = 'K'").select("id", F.concat(F.lit("K"), "o").alias("f")))
    packed = every.groupBy("id").agg(F.sort_array(F.collect_set("f")).alias("fs"))
    return (packed.withColumn("cls", F.substring(F.get(F.filter("fs", lambda f: f.startswith("K")), F.lit(0)), 2, 20)).where("cls is not null")
            .select("id", "cls", F.array_join(F.filter("fs", lambda f: ~f.startswith("K")), SPLIT).alias("profile")))


@lru_cache(maxsize=50_000)
def opened(profile: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for f in profile.split(SPLIT):
        if f:
            out.setdefault(f[0], []).append(f[1:])
    return out


def attribute_keys(profile: str, first: bool) -> set[str]:
    """Keys two records of one thing are likely to share; numbers with their tolerance on the first side only."""
    p = opened(profile)
    out = set()
    for n in p.get("N", ()):
        ws = n.rstrip("…").split()
        out.add("N" + " ".join(sorted(ws)))
        if len(ws) > 1:
            out |= {"H" + " ".join(ws[:(len(ws) + 1) // 2]), "H" + " ".join(ws[len(ws) // 2:])}
    for n in p.get("L", ()):
        out.add("L" + " ".join(sorted(n.split())))
    for c in p.get("C", ()):
        if ws := c.split("@")[0].split():
            out.add("C" + ws[-1])
    out |= {"D" + d for d in p.get("D", ()) if len(d) == 10} | {"P" + n for n in p.get("P", ())} | {"T" + t for t in p.get("T", ())}
    for kind, wide in (("U", 2), ("E", 2)):
        for n in p.get(kind, ()):
            out |= {f"{kind}{int(n) + k}" for k in (range(-wide, wide + 1) if first else (0,))}
    for x in p.get("X", ()):
        for y in p.get("Y", ()):
            at = (float(x) * 10, float(y) * 10)
            near = {(round(at[0] + a), round(at[1] + b)) for a in (-0.3, 0.3) for b in (-0.3, 0.3)} if first else {(round(at[0]), round(at[1]))}
            out |= {f"G{a},{b}" for a, b in near}
    return out


class _Bits(dict):
    def __missing__(self, pair: str) -> int:
        self[pair] = bit = 1 << len(self)
        return bit


_BITS = _Bits()


@lru_cache(maxsize=100_000)
def letter_pairs(text: str) -> tuple[int, int]:
    """The letter pairs of a flat text, a bit for each, and their number."""
    mask = 0
    for i in range(len(text) - 1):
        mask |= _BITS[text[i:i + 2]]
    return mask, mask.bit_count()


def alike(a: str, b: str) -> float:
    """Share of letter pairs two texts have in common, or of the shorter where one was cut."""
    if a == b:
        return 1.0
    if a.endswith("…") or b.endswith("…"):
        x, y = a.rstrip("…"), b.rstrip("…")
        return 0.9 if len(x) > 4 and len(y) > 4 and (x.startswith(y) or y.startswith(x)) else alike(x, y)
    (x, m), (y, n) = letter_pairs(a), letter_pairs(b)
    return 2 * (x & y).bit_count() / max(1, m + n)


@lru_cache(maxsize=50_000)
def maker_likeness(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0
    s = alike(" ".join(sorted(x)), " ".join(sorted(y)))
    if s < 0.8 and (len(x[0]) == 1 or len(y[0]) == 1) and x[0][0] == y[0][0] and alike(x[-1], y[-1]) > 0.75:
        return 0.9
    return s


def best(a: list[str], b: list[str], of) -> float | None:
    if len(a) == 1 == len(b):
        return of(a[0], b[0])
    return max((of(x, y) for x in a for y in b), default=None)


def steps(value: float | None, *levels: tuple[float, float]) -> float:
    """Score of the first level reached; the last level's is for all below; 0 if a side knows nothing."""
    if value is None:
        return 0.0
    return next((s for least, s in levels if value >= least), levels[-1][1])


def near(*bounds: tuple[float, float]):
    def of(a: str, b: str) -> float:
        d = abs(float(a) - float(b))
        return next((s for most, s in bounds if d <= most), bounds[-1][1])
    return of


def dates(a: str, b: str) -> float:
    if a == b:
        return 3.0 if len(a) == 10 and not a.endswith("-01-01") else 1.5
    short = min(len(a), len(b))
    if short < 10 and a[:short] == b[:short] or a[:4] == b[:4] and (a.endswith("-01-01") or b.endswith("-01-01")):
        return 1.0
    return -2.5


LENGTHS, PAGES, HEIGHTS, DEGREES = near((2, 2.0), (4, 1.0), (9e9, -2.0)), near((0, 2.0), (1, 1.0), (9e9, -2.0)), near((3, 1.5), (9e9, -1.5)), near((0.02, 1.5), (0.1, 0.5), (9e9, -2.5))


SCORED = (("D", dates), ("U", LENGTHS), ("P", PAGES), ("E", HEIGHTS), ("X", DEGREES), ("Y", DEGREES))
LIKE_NAMES, LIKE_MARKS = ((0.999, 3.0), (0.8, 2.4), (0.6, 1.6), (0.0, -3.0)), ((0.7, 0.5), (0.0, -2.5))
WORDED = (("L", ((0.7, 1.5), (0.5, 0.5), (0.0, -1.5))), ("B", ((0.55, 0.5), (0.0, -0.7))), ("T", ((0.7, 1.0), (0.0, -1.0))))


def attribute_score(a: dict[str, list[str]], b: dict[str, list[str]]) -> float:
    """Score of a pair of opened profiles without its makers."""
    s = steps(best(a["N"], b["N"], alike), *LIKE_NAMES) if "N" in a and "N" in b else 0.0
    va, vb = ([v for v in p.get("V", ()) if v != "-"] for p in (a, b))
    if va or vb:
        s += steps(best(va, vb, alike) or 0.0, *LIKE_MARKS)
    for k, of in SCORED:
        if k in a and k in b:
            s += best(a[k], b[k], of)
    return s + sum((steps(best(a[k], b[k], alike), *levels) for k, levels in WORDED if k in a and k in b), 0.0)


def compared(one: str, two: str) -> tuple[float, float | None]:
    """Score of a pair without its makers, and the likeness of the makers' names (none if a side has none, or the score is below 0)."""
    a, b = opened(one), opened(two)
    s = attribute_score(a, b)
    if s < 0 or "C" not in a or "C" not in b:
        return s, None
    names = lambda p: [c.split("@")[0] for c in p["C"] if c.split("@")[0]]
    return s, best(names(a), names(b), maker_likeness)


def _keyed(people: DataFrame, first: bool) -> DataFrame:
    def keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(n, f"{c}{k}") for n, c, p in zip(part.n, part.cls, part.profile) for k in attribute_keys(p, first)]
            yield pd.DataFrame(rows, columns=["n", "key"])
    return people.select("n", "cls", "profile").mapInPandas(keys, "n bigint, key string").select("n", F.xxhash64("key").alias("k"))


def candidate_pairs(one: DataFrame, two: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, w): the pruned candidate graph over profiles with row numbers n."""
    k1, k2 = (scratch.write(_keyed(p, first)) for p, first in ((one, True), (two, False)))

    def shared(x: DataFrame, y: DataFrame) -> DataFrame:
        n1, n2 = x.groupBy("k").agg(F.count(F.lit(1)).alias("n1")), y.groupBy("k").agg(F.count(F.lit(1)).alias("n2"))
        return n1.join(n2, "k")

    def linked(x: DataFrame, y: DataFrame, keys: DataFrame) -> DataFrame:
        return x.withColumnRenamed("n", "a").join(keys, "k").join(y.withColumnRenamed("n", "b"), "k").select("a", "b", (F.lit(1.0) / F.log2(F.lit(1.0) + F.col("n1") + F.col("n2"))).alias("w"))

    counts = scratch.write(shared(k1, k2))
    rare, common = counts.where(F.col("n1") * F.col("n2") <= RARE), counts.where(F.col("n1") * F.col("n2") > RARE).select("k")

    def doubled(x: DataFrame) -> DataFrame:
        held = x.join(common, "k").groupBy("n").agg(F.sort_array(F.collect_set("k")).alias("ks"))
        pair = F.expr("flatten(transform(ks, (u, i) -> transform(slice(ks, i + 2, size(ks)), v -> xxhash64(u, v))))")
        return held.select("n", F.explode(pair).alias("k"))

    d1, d2 = scratch.write(doubled(k1)), scratch.write(doubled(k2))
    edges = linked(k1, k2, rare).unionByName(linked(d1, d2, shared(d1, d2))).groupBy("a", "b").agg(F.sum("w").alias("w"))
    top = lambda c: F.max("w").over(Window.partitionBy(c))
    return edges.withColumn("ta", top("a")).withColumn("tb", top("b")).where(f"w >= {KEEP} * ta or w >= {KEEP} * tb").select("a", "b", "w")


def match_entities(spark: SparkSession, attributes_1: DataFrame, relations_1: DataFrame, schema_1: Schema, attributes_2: DataFrame, relations_2: DataFrame, schema_2: Schema,
                   most_rounds: int = 10) -> DataFrame:
    """(h1, h2, score, confidence): every matching pair of records once.

    Triples with a null part, values that can't be read and records of no class of the schemas are passed over; repeated
    rows change nothing; empty tables give no rows; other columns are ignored. A record may match several others.
    """
    scratch = Scratch(spark, "matching")
    one, two = (scratch.write(profiles(a, r, s, scratch).withColumn("n", F.monotonically_increasing_id())) for a, r, s in ((attributes_1, relations_1, schema_1), (attributes_2, relations_2, schema_2)))
    pairs = scratch.write(candidate_pairs(one, two, scratch))
    p1, p2 = one.select(F.col("n").alias("a"), F.col("id").alias("h1"), F.col("profile").alias("x")), two.select(F.col("n").alias("b"), F.col("id").alias("h2"), F.col("profile").alias("y"))

    def judged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for h1, h2, x, y in zip(part.h1, part.h2, part.x, part.y):
                s, like = compared(x, y)
                if s < 0:
                    continue
                makers = [(c, d) for c in opened(x).get("C", ()) for d in opened(y).get("C", ())]
                rows += [(h1, h2, s, like, c.split("@")[-1] or c, d.split("@")[-1] or d) for c, d in makers] or [(h1, h2, s, like, None, None)]
            yield pd.DataFrame(rows, columns=["h1", "h2", "base", "likeness", "c1", "c2"])

    full = pairs.join(p1, "a").join(p2, "b").select("h1", "h2", "x", "y")
    rows = scratch.write(full.mapInPandas(judged, "h1 string, h2 string, base double, likeness double, c1 string, c2 string"))
    by_name = F.when(F.col("likeness").isNull(), 0.0).when(F.col("likeness") >= 0.8, 1.5).when(F.col("likeness") >= 0.6, 0.5).otherwise(-2.0)
    state = scratch.write(rows.withColumn("score", F.col("base") + by_name))
    for _ in range(most_rounds):
        sure = state.where("c1 is not null").select("h1", "h2", "c1", "c2", F.lit(1.0).alias("one"), (F.col("score") >= ACCEPT).cast("double").alias("own"))
        linked = sure.groupBy("c1", "c2").agg(F.sum("own").alias("yes"), F.sum("one").alias("all"))
        # makers that other likely matches link speak for a pair as like names do
        update = (state.join(linked, ["c1", "c2"], "left")
                  .withColumn("others", (F.col("yes") - (F.col("score") >= ACCEPT).cast("double")) / F.greatest(F.lit(1.0), F.col("all") - 1))
                  .withColumn("new", F.col("base") + F.when(F.coalesce(F.col("yes"), F.lit(0.0)) - (F.col("score") >= ACCEPT).cast("double") >= 2, F.when(F.col("others") >= 0.5, F.greatest(by_name, F.lit(1.5))).otherwise(by_name)).otherwise(by_name)))
        after = scratch.write(update.select("h1", "h2", "base", "likeness", "c1", "c2", F.col("new").alias("score"), ((F.col("new") >= ACCEPT) != (F.col("score") >= ACCEPT)).alias("changed")))
        stable = not after.where("changed").take(1)
        state = after.drop("changed")
        if stable:
            break
    last = state.groupBy("h1", "h2").agg(F.max("score").alias("score"))
    top = last.withColumn("top", F.max("score").over(Window.partitionBy("h1")))
    return top.where(f"score >= {ACCEPT} and score >= top - {MARGIN}").select("h1", "h2", "score", (F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(ACCEPT - 0.5) - F.col("score")))).alias("confidence"))
