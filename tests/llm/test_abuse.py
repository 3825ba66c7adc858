import pandas as pd

from kinloom.llm.abuse import flagged, plain, scored_documents, sentences, source_rates
from pyspark.sql import functions as F

SAMPLES = "/root/testdata/sf0.001/abuse_samples.parquet"


def test_disguises_are_undone():
    assert plain("You p.o.r.n a$$hole іmbecіl") == "you porn asshole imbecil" and "moron" in plain("moooron") and "scum" in plain("that subhuman sc*m.")
    assert sentences(None) == [] and len(sentences("One. Two!\nThree")) == 3


def test_held_out_samples_and_plain_texts(spark):
    """Half of the labelled samples are kept from the fit and hidden among plain texts."""
    pdf = pd.read_parquet(SAMPLES).sort_values("sample_id")
    kept, shown = pdf.iloc[::2], pdf.iloc[1::2]
    filler = "The reissue was sold for 40 crowns. A later pressing adds a small coda. "
    docs = [(int(i), filler + t + " Listeners still request it.", "clash") for i, t in zip(kept.sample_id, kept.sample_text)] + [(10_000 + i, filler * (i % 4), None) for i in range(300)] + [(20_000, None, None), (20_001, "", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, category string")
    scores = scored_documents(spark, df, spark.createDataFrame(shown)).cache()
    assert scores.count() == len(docs)
    got = {(r.doc_id, r.category) for r in flagged(scores).collect()}
    want = {(int(i), c) for i, c in zip(kept.sample_id, kept.category) if c != "none"}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    rates = source_rates(scores, df.withColumn("source", F.lit("s")), F.col("source")).collect()
    assert len(rates) == 1 and rates[0].n_docs == len(docs)
    assert scored_documents(spark, df.limit(0), spark.createDataFrame(shown)).collect() == []
