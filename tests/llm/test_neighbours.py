"""Words near a term of the toxicity lexicon, edge rows of the scores, and long quotations."""

import time

import pytest
from pyspark.sql import functions as F

from tableflow.llm import toxicity

TERMS = ["idiot", "scum"]


def test_a_neighbour_met_in_clean_documents_is_no_sign():
    near = [("idiom", 0, 1, "idiot"), ("idiots", 3, 0, "idiot"), ("idoit", 1, 0, "idiot"), ("idjot", 1, 0, "idiot")]
    near += [(f"s{i}", i % 8 == 0, i % 8 != 0, "scum") for i in range(80)]
    variants, others = toxicity.neighbour_weights(near, TERMS, 0.12)
    assert variants["idiom"] < 0.1 and variants["idiots"] > 0.9
    assert others["scum"] < 0.05 and variants["s0"] < 0.3
    assert others["idiot"] > others["scum"]


def test_without_neighbours_unseen_ones_count_as_agreed():
    variants, others = toxicity.neighbour_weights([], TERMS, 0.3)
    assert not variants and others == pytest.approx(dict.fromkeys(TERMS, toxicity.UNSEEN))
    many, _ = toxicity.neighbour_weights([("scums", 5_000, 0, "scum"), ("scud", 0, 5_000, "scum")], TERMS, 0.5)
    assert many["scums"] > 0.99 and many["scud"] < 0.01


def test_many_quoted_hits_take_no_square_of_time(spark):
    model = toxicity.ToxicityModel({"idiot": 0.9}, {}, {}, 0.0, 0.0)

    class Sent:
        value = model

    row = toxicity._scorer(Sent, 12, 0.25, 0.01, 0.2, 1_000)()
    text = ('"you idiot" ' * 50_000).encode()
    start = time.perf_counter()
    score, hits, quoted, _ = row(text)
    assert time.perf_counter() - start < 5 and hits == quoted == 50_000 and score < 0.3
    assert row(('"you idiot" ' * 5 + "you idiot").encode())[0] > 0.8


def test_empty_documents_and_clashing_columns(spark):
    model = toxicity.ToxicityModel({"idiot": 0.9}, {}, {}, 0.0, 0.0)
    docs = spark.createDataFrame([(1, "an idiot", 5.0)], "doc_id long, text string, score double")
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    out = toxicity.score_documents(docs.withColumn("toxicity", F.lit("old")), model).first()
    assert out["score"] == 5.0 and out["toxicity"]["score"] > 0.8
