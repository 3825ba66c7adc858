from kinloom.llm.matching import Schema, facts, match_entities
from kinloom.llm.queries import GRAPH_1, W3, graph_2

E = "http://www.wikidata.example/entity/"
D = "http://www.wikidata.example/prop/direct/P"
A1 = [("_:r1", "schema:name", '"The Small Railway"'), ("_:r1", "schema:duration", '"PT3M20S"'), ("_:r1", "schema:datePublished", '"1970-05-10"'), ("_:n1", "schema:name", '"Ulvo, Marek"'),
      ("_:r2", "http://schema.example/name/", '"small railway, the (Live at Torvik)"'), ("_:r2", "schema:duration", '"4:41"'), ("_:r2", "schema:datePublished", '"1975"'),
      ("_:a1", "schema:name", '"Torvik Airport"'), ("_:a1", "schema:latitude", '"10.25"'), ("_:a1", "schema:longitude", '"-3.5"'), (None, "schema:name", '"x"'), ("_:r1", "schema:name", None), ("_:x", "schema:name", '"The Small Railway"')]
R1 = [("_:r1", W3 + "1999/02/22-rdf-syntax-ns#type", "schema:MusicRecording"), ("_:r1", "schema:byArtist", "_:n1"), ("_:r2", W3 + "1999/02/22-rdf-syntax-ns#type", "<http://schema.example/musicrecording>"), ("_:a1", W3 + "1999/02/22-rdf-syntax-ns#type", "schema:Airport")]
LABEL = W3 + "2000/01/rdf-schema#label"
A2 = [(E + "Q1", LABEL, '"music"@en'), (E + "Q2", LABEL, '"airport"@en'), ("wd:Q10", LABEL, '"The Small Railway"@en'), ("wd:Q10", D + "90004", '"200"'), ("wd:Q10", D + "90003", '"1970-05-10T00:00:00Z"'), (E + "Q30", LABEL, '"Marek Ulvo"@en'),
      ("wd:Q11", LABEL, '"The Small Railway (Live at Torvik)"@en'), ("wd:Q11", D + "90004", '"281"'), ("wd:Q11", D + "90003", '"1975-01-01T00:00:00Z"'), ("wd:Q12", LABEL, '"Torvik Airport"@en'), ("wd:Q12", D + "90020", '"Point(-3.5001 10.2502)"')]
R2 = [("wd:Q10", D + "90001", E + "Q1"), ("wd:Q10", D + "90002", E + "Q30"), ("wd:Q11", D + "90001", "wd:q1"), ("wd:Q12", D + "90001", E + "Q2")]


def test_editions_are_told_apart(spark):
    frames = [spark.createDataFrame([(*x, "clash") for x in rows] * 2, "h string, r string, t string, score string") for rows in (A1, R1, A2, R2)]
    a1, r1, a2, r2 = frames
    got = match_entities(spark, a1, r1, GRAPH_1, a2, r2, graph_2(a2)).collect()
    assert {(r.h1, r.h2) for r in got} == {("_:r1", E + "Q10"), ("_:r2", E + "Q11"), ("_:a1", E + "Q12")} and len(got) == 3
    assert all(0.5 < r.confidence < 1 for r in got)
    none = a1.limit(0)
    assert match_entities(spark, none, none, GRAPH_1, a2, r2, graph_2(a2)).collect() == []


def test_facts():
    assert dict(facts("N", '"Golden Clock (Revised edition) | buy online"')) == {"N": "golden clock", "V": "revised edition"}
    assert facts("C", '"Ulvo, Marek feat. Joreth"') == (("C", "marek ulvo"),) and facts("D", '"1998-04"') == (("D", "1998-04"),) and facts("U", '"live"') == ()
    assert Schema({}, {}, "t", []).places == []
