"""What the comparison of candidate pairs leaves out, and that its scores stay."""

from kinloom.llm import matching
from kinloom.llm.matching import SPLIT, alike, compared
from kinloom.llm.queries import CLASS_LABELS, graph_2

W3 = "http://www.w3.example/"


def test_makers_of_lost_pairs_are_not_compared(monkeypatch):
    """p3_found took most of its time for pairs whose score without makers is below 0; those are dropped."""
    asked = []
    monkeypatch.setattr(matching, "maker_likeness", lambda a, b: asked.append((a, b)) or 1.0)
    lost = [SPLIT.join(("Nquiet harbour", "V-", "D1970-05-10", "Cmarek ulvo@_:n1")), SPLIT.join(("Niron clock", "V-", "D1999-02-03", "Cmarek ulvo@Q3"))]
    kept = [SPLIT.join(("Nsmall railway", "V-", "D1970-05-10", "U200", "Cmarek ulvo@_:n1", "Lfirst songs")), SPLIT.join(("Nsmall railways", "Vlive", "D1970", "U203", "Cm ulvo@Q3", "C@Q4", "Lfirst song"))]
    assert compared(*lost) == (-5.5, None) and asked == []
    assert compared(*kept) == (2.4 - 2.5 + 1.0 + 1.0 + 1.5, 1.0) and asked == [("marek ulvo", "m ulvo")]


def test_alike_is_the_share_of_letter_pairs():
    pairs = lambda x: {x[i:i + 2] for i in range(len(x) - 1)}
    texts = ["", "a", "aa", "aaaa", "small railway", "small railways", "railway small", "ab ba", "9 lives", "torvik"]
    for a in texts:
        for b in texts:
            assert alike(a, b) == (1.0 if a == b else 2 * len(pairs(a) & pairs(b)) / max(1, len(pairs(a)) + len(pairs(b))))
    assert alike("small rail…", "small railway") == 0.9


def test_classes_of_graph_2_in_any_spelling(spark):
    rows = [("wd:Q1", "<" + W3 + "2000/01/rdf-schema#Label/>", '"Music"@en'), ("wd:Q2", W3 + "2000/01/rdf-schema#label", " BOOK "), ("wd:Q3", W3 + "2000/01/rdf-schema#label", '"airport" .'), ("wd:Q4", W3 + "2000/01/rdf-schema#label", '"bookshop"@en'),
            ("wd:Q5", W3 + "2004/02/skos/core#altLabel", '"book"@en'), ("wd:Q6", W3 + "2000/01/rdf-schema#label", None), (None, W3 + "2000/01/rdf-schema#label", '"book"'), ("wd:Q7", None, '"book"')]
    got = graph_2(spark.createDataFrame(rows, "h string, r string, t string")).classes
    assert {k.rsplit("/", 1)[1]: v for k, v in got.items()} == {"Q1": CLASS_LABELS["music"], "Q2": CLASS_LABELS["book"], "Q3": CLASS_LABELS["airport"]}
