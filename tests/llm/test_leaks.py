import random

from kinloom.llm.leaks import leaked_items

RNG = random.Random(3)
VOCAB = [f"w{i}" for i in range(400)]
INTRO = "choose the candidate link that is wrong then explain your choice in one short sentence".split()


def edits(a, b):
    """Least edits that turn all of ``a`` into some stretch of ``b``, by the plain recurrence."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    return {(d, i) for d, x in docs for i, t in items for size, most in ((15, 1), (20, 2))
            for s in range(len(t) - size + 1) if s >= len(INTRO) and edits(t[s:s + size], x) <= most}


def test_leaks_equal_plain_search(spark):
    items = [(i, INTRO + RNG.sample(VOCAB, 40)) for i in range(6)]
    docs = []
    for d in range(60):
        own = RNG.choice(items)[1]
        start, size = RNG.randint(len(INTRO), 30), RNG.randint(10, 26)
        part = own[start:start + size]
        for _ in range(RNG.randint(0, 3)):
            k = RNG.randrange(len(part))
            part[k:k + RNG.randint(0, 1)] = RNG.choice([[], ["new"], ["x", "y"]])
        docs.append((d, RNG.choices(["f" + w for w in VOCAB], k=30) + part + RNG.choices(["f" + w for w in VOCAB], k=20)))
    docs += [(100, INTRO * 2), (101, [])]
    df = spark.createDataFrame([(d, " , ".join(x).upper() if d % 2 else "<b>" + "</b> <i>".join(x), "clash") for d, x in docs] + [(102, None, None)], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(90, None), (91, "too short"), (None, "x")], "item_id bigint, item_text string")
    got = {tuple(r) for r in leaked_items(spark, df.union(df.limit(3)), it).collect()}
    assert got == brute(docs, items) and got
    assert leaked_items(spark, df.where("doc_id < 0"), it).collect() == [] and leaked_items(spark, df, it.where("item_id < 0")).collect() == []


def test_shared_passages_prove_nothing(spark):
    same = RNG.sample(VOCAB, 30)
    it = spark.createDataFrame([(1, " ".join(same)), (2, " ".join(same))], "item_id bigint, item_text string")
    assert leaked_items(spark, spark.createDataFrame([(1, " ".join(same))], "doc_id bigint, text string"), it).collect() == []
