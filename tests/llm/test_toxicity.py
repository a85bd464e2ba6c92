import random

import pytest
from helpers import awkward, empty, words

from tillroll.llm import toxicity

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def taught(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        w, bad = words(rng, 60), i % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["vilefoo", "vilebar", "grumpish"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return toxicity.train(docs, spark.createDataFrame(labels, LABELS)), docs, dict((a, c) for a, _, c in labels[:240])


def test_held_out_texts_are_told_apart(spark, taught):
    model, docs, truth = taught
    got = toxicity.score(docs, model, keep=["doc_id"]).collect()
    assert all((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in got)
    # an unseen form of a known stem, homoglyphs, digits and zero-width characters
    fresh = ["w1 vilebaz w2 vilequx", "w1 v1lef00 w3 grum​p1sh", "w2 vіlеfоо w7 vilebar", "w1 w2 w3", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(fresh)], "doc_id bigint, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert [scores[i] >= 0.5 for i in range(6)] == [True, True, True, False, False, False]
    assert scores[3] == scores[4] == scores[5]


def test_exception_phrases_excuse_a_match():
    model = toxicity.Model({toxicity.fold("clown"): 6.0})
    machine = model.machine()
    assert toxicity.density(machine, "you clown") > 0
    assert toxicity.density(machine, "a clown fish swims") == 0
    assert toxicity.density(machine, "a clown fish and a clown") > 0


def test_length_normalises():
    machine = toxicity.Model({toxicity.fold("bad"): 5.0}).machine()
    assert toxicity.density(machine, "bad " + "w " * 50_000) < toxicity.density(machine, "bad w")


def test_awkward_rows(spark, taught):
    model, docs, _ = taught
    rows = awkward(spark)
    scored = toxicity.score(rows.drop("score"), model).collect()
    assert len(scored) == rows.count() and all(0 <= r["score"] <= 1 for r in scored)
    labels = spark.createDataFrame([], LABELS)
    kept = toxicity.drop_toxic(rows, labels)
    assert kept.columns == rows.columns and kept.count() == rows.count()  # nothing taught: nothing goes
    assert toxicity.drop_toxic(empty(spark), labels).count() == 0
