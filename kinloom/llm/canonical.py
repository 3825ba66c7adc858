"""Freely typed values mapped to the entry of a reference list they mean, by a symmetric-delete dictionary.

Each entry is written in the ways people shorten it: a word of ABBREVIATIONS cut, the first or the last generic word as
its initial, generic words at the end left out, words sorted. Of each writing the first and the last EDGE characters, with
up to DELETES characters left out, are the dictionary's keys. A value (and its variants: comma parts turned round, words
sorted, legal suffixes and qualifiers left out) finds every writing that shares a key; as one half of a string has at most
DELETES of up to 2 * DELETES + 1 edits, a writing within the bound shares a key (but for edits that crowd in the middle of
strings shorter than two edges). Candidates are ranked by weighted
Damerau-Levenshtein distance (swapped neighbours, doubled letters and vowels for vowels cost less) plus what the writing
leaves out, then by how often the entry is named exactly, then by the smaller id. A value nearest to two entries of
the same distance and frequency, or to none within the bound, is a miss.

Distinct values are looked up once each, in a map; the list is broadcast in blocks of at most BLOCK entries, so its size is
bounded whatever the list's, and the best match of all blocks is kept.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.words import folded, mended
from kinloom.operators.skew import skew_join
from kinloom.session import Scratch

EDGE = 8
DELETES = 2
BLOCK = 20_000
# Words that add nothing to a name, and how words of names are shortened.
SUFFIXES = {"gmbh", "ltd", "co", "inc", "llc", "ag", "plc", "limited", "corp", "city", "town", "of", "the"}
ABBREVIATIONS = {
    "records": ("rec", "recs"), "recordings": ("rec", "recs"), "company": ("co",), "music": ("mus",), "sound": ("snd",), "works": ("wks",),
    "press": ("pr",), "publishers": ("publ", "pub", "pubs"), "publishing": ("publ", "pub"), "house": ("hse",), "university": ("univ", "uni"),
    "saint": ("st",), "port": ("pt",), "new": ("nw",), "editions": ("ed", "eds"), "and": ("u", "n"), "brothers": ("bros",),
}
GENERIC = {"records", "recordings", "company", "music", "sound", "works", "press", "publishers", "publishing", "house", "university", "editions", "sons", "and"}
PLACEHOLDERS = {"", "na", "tbd", "none", "null", "nil", "unknown", "various", "seecover", "selfreleased", "12345", "undefined", "untitled", "anonymous"}
VOWELS = set("aeiouy")


def pieces(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", folded(mended(text)).replace("&", " and ").replace("+", " and "))


def writings(name: str) -> dict[str, float]:
    """The ways an entry is written, without spaces, and what each leaves out."""
    full = pieces(name)
    out: dict[str, float] = {}

    def add(ws: list[str], cost: float) -> None:
        for x, more in (("".join(ws), 0.0), ("".join(sorted(ws)), 0.05)):
            out[x] = min(out.get(x, 9.0), cost + more)

    cuts = [(full, 0.0)]
    ws = full
    while len(ws) > 1 and ws[-1] in GENERIC and any(w not in GENERIC for w in ws[:-1]):
        ws = ws[:-1]
        cuts.append((ws, 0.3 * (len(full) - len(ws))))
    if full[0] in GENERIC and len(full) > 1:
        cuts.append((full[1:], 0.4))
    if "on" in full[1:-1]:
        cuts.append(([w for w in full if w != "on"], 0.2))
    for ws, cost in cuts:
        choices = [(w, *ABBREVIATIONS.get(w, ())) for w in ws]
        for pick in itertools.islice(itertools.product(*choices), 64):
            short = 0.1 * sum(a != b for a, b in zip(pick, ws))
            add(list(pick), cost + short)
            if short and len(ws) > 2:
                add([ws[0][0], *pick[1:]], cost + short + 0.5)
        if len(ws) > 1:
            add([ws[0][0], *ws[1:]], cost + 0.5)
            add([*ws[:-1], ws[-1][0]], cost + 0.5)
    if len(full) > 2 and full[-1] in GENERIC:
        for short in ABBREVIATIONS.get(full[-1], ()):
            add([full[0][0], *full[1:-1], short], 0.6)
    return {x: c for x, c in out.items() if len(x) > 3}


def added(w: str) -> bool:
    """Whether a word at an end of a value adds nothing: a suffix, with at most one slip if it isn't very short."""
    return w in SUFFIXES or 3 <= len(w) <= 5 and any(distance(w, x, 1) <= 1 for x in ("gmbh", "ltd", "city", "town"))


def variants(value: str) -> dict[str, float]:
    """What a typed value may stand for, without spaces, and what each variant takes away."""
    parts = [p for p in (pieces(x) for x in value.split(",")) if p]
    out: dict[str, float] = {}
    for order in {tuple(range(len(parts))), tuple(reversed(range(len(parts)))), (*range(1, len(parts)), 0) if parts else ()}:
        ws = [w for i in order for w in parts[i]]
        bare = list(ws)
        while len(bare) > 1 and added(bare[-1]):
            bare = bare[:-1]
            out.setdefault("".join(bare), 0.1)
        while len(bare) > 1 and added(bare[0]):
            bare = bare[1:]
        inner = [w for w in bare if w not in SUFFIXES]
        for x, cost in ((ws, 0.0), (bare, 0.1), (sorted(ws), 0.05), (sorted(bare), 0.15), (inner, 0.15), (sorted(inner), 0.2)):
            key = "".join(x)
            out[key] = min(out.get(key, 9.0), cost)
    for x in list(out):
        for end in ("gmbh", "ltd", "co", "inc", "city", "cityof", "town"):
            if x.endswith(end) and len(x) > len(end) + 3:
                key = x[:-len(end)]
                out[key] = min(out.get(key, 9.0), out[x] + 0.1)
    return out


def keys(x: str) -> set[str]:
    """Both edges of a writing with up to DELETES characters left out."""
    out = set()
    for mark, edge in (("<", x[:EDGE]), (">", x[-EDGE:])):
        for n in range(DELETES + 1):
            out.update(mark + "".join(edge[i] for i in range(len(edge)) if i not in gone) for gone in itertools.combinations(range(len(edge)), n))
    return out


def allowed(n: int) -> float:
    """Most edits for a writing of n characters."""
    return 1 if n < 8 else 2 if n < 14 else 3 if n < 20 else 4


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance, or more than ``most``."""
    before, row = [], [0.0] * (len(b) + 1)
    for j in range(1, len(b) + 1):
        row[j] = row[j - 1] + (0.7 if j > 1 and b[j - 1] == b[j - 2] else 1.0)
    for i in range(1, len(a) + 1):
        last, row, older = row, [row[0] + (0.7 if i > 1 and a[i - 1] == a[i - 2] else 1.0)], before
        x = a[i - 1]
        for j in range(1, len(b) + 1):
            y = b[j - 1]
            best = last[j - 1] + (0.0 if x == y else 0.9 if x in VOWELS and y in VOWELS else 1.0)
            best = min(best, last[j] + (0.7 if i > 1 and x == a[i - 2] else 1.0), row[j - 1] + (0.7 if j > 1 and y == b[j - 2] else 1.0))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                best = min(best, older[j - 2] + 0.8)
            row.append(best)
        before = last
        if min(row) > most + 1:
            return most + 1
    return row[-1]


def letters(x: str) -> np.ndarray:
    return np.bincount(np.frombuffer(x.encode("ascii", "replace"), np.uint8) & 63, minlength=64).astype(np.int16)


class Dictionary:
    def __init__(self, entries: list[tuple[int, str, int]]):
        self.forms: list[tuple[str, float, int, int]] = []
        under: dict[str, list[int]] = defaultdict(list)
        for canon, name, often in entries:
            for x, cost in writings(name).items():
                for key in keys(x):
                    under[key].append(len(self.forms))
                self.forms.append((x, cost, canon, often))
        self.under = {k: np.array(v, dtype=np.int32) for k, v in under.items()}
        self.bags = np.array([letters(x) for x, *_ in self.forms])
        self.most = np.array([min(allowed(len(x)), 2) if less >= 0.4 else allowed(len(x)) for x, less, *_ in self.forms])

    def ranked(self, value: str) -> list[tuple[float, int, int]]:
        """(distance, -frequency, id) of the entries within the bound, best first, one each."""
        best: dict[int, tuple[float, int, int]] = {}
        for x, cost in sorted(variants(value).items(), key=lambda v: v[1]):
            if x in PLACEHOLDERS or len(x) < 3:
                continue
            places = [self.under[key] for key in keys(x) if key in self.under]
            if not places:
                continue
            places = np.unique(np.concatenate(places))
            # an edit of the least weight moves at most two letter counts
            differ = np.abs(self.bags[places] - letters(x)).sum(axis=1)
            own = np.minimum(self.most[places], allowed(len(x)))
            for p, most in zip(places[differ <= 2 * np.ceil(own / 0.7)].tolist(), own[differ <= 2 * np.ceil(own / 0.7)].tolist()):
                form, less, canon, often = self.forms[p]
                if canon in best:
                    most = min(most, best[canon][0] - cost - less)
                if most < 0 or (d := distance(x, form, most)) > most:
                    continue
                score = (round(d + cost + less, 3), -often, canon)
                if canon not in best or score < best[canon]:
                    best[canon] = score
        return sorted(best.values())


_LOADED: dict[int, Dictionary] = {}


def _dictionary(shared) -> Dictionary:
    """Built once in each worker from the broadcast entries."""
    key = hash(tuple(shared.value))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Dictionary(shared.value)
    return _LOADED[key]


def nearest_entries(spark: SparkSession, values: DataFrame, entries: DataFrame, value: str = "value", entry_id: str = "canon_id", name: str = "canon_name") -> DataFrame:
    """(value, entry_id, cost): one row for each distinct value that isn't null, in lower case with single spaces; entry_id
    is null (a miss) where no entry, or no single one, is near enough. Blank values and placeholders are misses, entries without id or name are passed
    over, repeated entries count once, an empty list makes every value a miss."""
    typed = F.lower(F.trim(F.regexp_replace(F.col(value), r"[\s_-]+", " ")))
    distinct = values.where(F.col(value).isNotNull()).groupBy(typed.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    plain = lambda c: F.regexp_replace(F.lower(c), "[^\\p{L}0-9]+", "")
    listed = entries.where(F.col(entry_id).isNotNull() & F.col(name).isNotNull()).select(F.col(entry_id).cast("bigint").alias("e"), F.col(name).alias("name")).distinct()
    often = distinct.groupBy(plain(F.col("v")).alias("k")).agg(F.sum("n").alias("n"))
    rows = listed.withColumn("k", plain(F.col("name"))).join(often, "k", "left").orderBy("e", "name").toLocalIterator()
    out = None
    for block in iter(lambda: list(itertools.islice(rows, BLOCK)), []):
        shared = spark.sparkContext.broadcast([(r.e, r["name"], r.n or 0) for r in block])

        def look(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            words = _dictionary(shared)
            for part in parts:
                found = []
                for v in part.v:
                    found += [(v, e, d, f) for d, f, e in words.ranked(v)[:2]]
                yield pd.DataFrame(found, columns=["v", "e", "d", "f"])

        hits = distinct.select("v").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(look, "v string, e bigint, d double, f bigint")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return distinct.select(F.col("v").alias(value), F.lit(None).cast("bigint").alias(entry_id), F.lit(None).cast("double").alias("cost"))
    two = out.groupBy("v").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "f", "e"))), 1, 2).alias("x"))
    first, second = F.col("x")[0], F.get("x", F.lit(1))
    clear = second.isNull() | (second.d > first.d) | (second.f > first.f)
    best = two.select("v", F.when(clear, first.e).alias(entry_id), F.when(clear, first.d).alias("cost"))
    return distinct.select("v").join(best, "v", "left").withColumnRenamed("v", value)


def map_values(spark: SparkSession, rows: DataFrame, value: str, entries: DataFrame, entry_id: str = "canon_id", name: str = "canon_name") -> DataFrame:
    """``rows`` with the entry each value names (null: none) in a new column entry_id; hot values meet a broadcast."""
    scratch = Scratch(spark, "values")
    found = scratch.write(nearest_entries(spark, rows, entries, value, entry_id, name).select(F.col(value).alias("_typed"), entry_id))
    typed = rows.withColumn("_typed", F.lower(F.trim(F.regexp_replace(F.col(value), r"[\s_-]+", " "))))
    return skew_join(typed, found, "_typed", "left").drop("_typed")
