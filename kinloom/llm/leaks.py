"""Evaluation texts leaking into training text, by a prefix-filtered set join.

A document holds a passage of an item if LEAST words of the item in a row occur in it in order with at most one word
in ten changed, added or dropped. Any such passage contains a window of 15 item words with at most one edit or one of 20
with at most two (longer ones can be cut at an edit), so windows of these two sizes are the sets to be joined. One edit
breaks at most SHINGLE shingles: a matching window keeps at least 6 of its 11 (or 16) shingles of five words.

1. The shingles of all items are counted over all documents (one scan, combined map-side); they are ordered by rarity.
2. A window that keeps c of its n shingles must share one of its n - c + 1 rarest: only these prefix shingles are looked
   up in each document.
3. A hit is a place in the item and one in the document. Length and positional bounds: the document must hold at least c
   of the window's shingles within the window's length plus its edits around that place.
4. What is left is verified exactly: banded edit distance of the item window against the document's words there.

The items are a stated query set: they meet every document in blocks of at most BLOCK shingles, each broadcast below that
bound, in a map over the documents; no document text is shuffled. Windows that lie mostly in a run of words that several
items share (SHARED words or more), or that occur in another item with those edits, prove nothing and are dropped.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.words import words

SHINGLE = 5
SHAPES = ((15, 1), (20, 2))
SHARED = 10
BLOCK = 400_000


def shingles(ws: list[str]) -> list[int]:
    codes = [zlib.crc32(w.encode()) for w in ws]
    return [hash((codes[i], codes[i + 1], codes[i + 2], codes[i + 3], codes[i + 4])) for i in range(len(codes) - SHINGLE + 1)]


def common_runs(texts: dict[int, list[str]]) -> dict[int, list[bool]]:
    """For each word of each item: whether it lies in a run of at least SHARED words that another item has as well."""
    owners = defaultdict(set)
    for i, ws in texts.items():
        for k in range(len(ws) - SHARED + 1):
            owners[tuple(ws[k:k + SHARED])].add(i)
    out = {}
    for i, ws in texts.items():
        flags = [False] * len(ws)
        for k in range(len(ws) - SHARED + 1):
            if len(owners[tuple(ws[k:k + SHARED])]) > 1:
                flags[k:k + SHARED] = [True] * SHARED
        out[i] = flags
    return out


def within(a: list[str], b: list[str], most: int) -> bool:
    """Whether all of ``a`` occurs as one stretch of ``b`` with at most ``most`` edits."""
    row = [0] * (len(b) + 1)
    for i, w in enumerate(a, 1):
        last, row[0] = row[0], i
        least = i
        for j, x in enumerate(b, 1):
            keep = row[j]
            row[j] = last if w == x else 1 + min(last, keep, row[j - 1])
            last = keep
            if row[j] < least:
                least = row[j]
        if least > most:
            return False
    return min(row) <= most


class Index:
    """Windows of a block of items under the prefix shingles of each."""

    def __init__(self, texts: dict[int, list[str]], shared: dict[int, list[bool]], counts: dict[int, int]):
        self.texts, self.windows, self.under = texts, [], defaultdict(list)
        for i, ws in texts.items():
            codes = shingles(ws)
            for size, most in SHAPES:
                n = size - SHINGLE + 1
                keep = n - SHINGLE * most
                for start in range(len(ws) - size + 1):
                    if 2 * sum(shared[i][start:start + size]) >= size:
                        continue
                    own = codes[start:start + n]
                    order = sorted(range(n), key=lambda k: (counts.get(own[k], 0), own[k], k))
                    at = len(self.windows)
                    self.windows.append((i, start, size, most, frozenset(own), keep))
                    for k in order[:n - keep + 1]:
                        self.under[own[k]].append((at, k))

    def matches(self, ws: list[str], done: set[int]) -> Iterator[int]:
        """Numbers of the windows that occur in ``ws``; windows of items in ``done`` are passed over."""
        codes, tried = shingles(ws), set()
        for place, code in enumerate(codes):
            for at, k in self.under.get(code, ()):
                i, start, size, most, own, keep = self.windows[at]
                first = max(0, place - k - most)
                if i in done or (at, first) in tried:
                    continue
                tried.add((at, first))
                around = codes[first:place - k + size - SHINGLE + 1 + most]
                if len(own.intersection(around)) >= min(keep, len(own)) and within(self.texts[i][start:start + size], ws[first:place - k + size + most], most):
                    yield at

    def found(self, ws: list[str]) -> set[int]:
        out: set[int] = set()
        for at in self.matches(ws, out):
            out.add(self.windows[at][0])
        return out

    def without_shared(self, everything: dict[int, list[str]]) -> Index:
        """Drops the windows that another item holds as well, edits allowed."""
        shared = {at for j, ws in everything.items() for at in self.matches(ws, {j})}
        self.under = {c: kept for c, places in self.under.items() if (kept := [p for p in places if p[0] not in shared])}
        return self


def _blocks(texts: dict[int, list[str]]) -> Iterator[dict[int, list[str]]]:
    block, n = {}, 0
    for i, ws in texts.items():
        if block and n + len(ws) > BLOCK:
            yield block
            block, n = {}, 0
        block[i] = ws
        n += len(ws)
    if block:
        yield block


def leaked_items(spark: SparkSession, documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(doc_id, item_id) once for each document that holds a passage of an item; whole texts on both sides.

    Null or short texts and items of fewer than 15 words match nothing; rows repeated with one doc_id count once; a null
    doc_id is reported as null; empty tables give no rows; other columns are ignored. The items are read to the driver in
    full: they are the query set, whose size is that of the evaluation material, not of the corpus.
    """
    texts = {r[0]: words(r[1]) for r in items.where(F.col(item_id).isNotNull()).select(item_id, item_text).orderBy(item_id).collect()}
    texts = {i: ws for i, ws in texts.items() if len(ws) >= SHAPES[0][0]}
    shared = common_runs(texts)
    docs = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("x")).where(F.length("x") > 0)
    kinds = f"{doc_id} {dict(documents.dtypes)[doc_id]}, {item_id} {dict(items.dtypes)[item_id]}"
    out = spark.createDataFrame([], kinds)
    for block in _blocks(texts):
        wanted = spark.sparkContext.broadcast({c for ws in block.values() for c in shingles(ws)})

        def count(parts: Iterator[pd.DataFrame], wanted=wanted) -> Iterator[pd.DataFrame]:
            n: dict[int, int] = defaultdict(int)
            for part in parts:
                for x in part.x:
                    for c in wanted.value.intersection(shingles(words(x))):
                        n[c] += 1
            yield pd.DataFrame({"c": list(n), "n": list(n.values())})

        counts = docs.select("x").mapInPandas(count, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
        rarity = {r.c: r.n for r in counts.collect()}  # at most the shingles of the block
        index = spark.sparkContext.broadcast(Index(block, shared, rarity).without_shared(texts))

        def search(parts: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for part in parts:
                hits = [(d, i) for d, x in zip(part.d, part.x) for i in index.value.found(words(x))]
                yield pd.DataFrame(hits, columns=["d", "i"], dtype=object)

        rows = docs.mapInPandas(search, f"d {dict(documents.dtypes)[doc_id]}, i {dict(items.dtypes)[item_id]}")
        out = out.unionByName(rows.select(F.col("d").alias(doc_id), F.col("i").alias(item_id)))
    return out.distinct()
