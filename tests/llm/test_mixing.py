import math
from collections import Counter, defaultdict

import pytest
from helpers import awkward, awkward_rows, empty

from tillroll.llm import mixing
from tillroll.llm.common import Staging

COUNTS = {"a": 40, "b": 12, "c": 6, None: 3}


def corpus(spark):
    rows = []
    for source, n in COUNTS.items():
        rows += [(len(rows) + i, " ".join(["w"] * (3 + i % 5)), source) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def totals(spark):
    rows, df = corpus(spark)
    return mixing.shares(mixing._counted(df, "doc_id", "text", "source"), Staging(spark, "test"))


def weights(tokens, a):
    z = sum(t ** a for t in tokens)
    return [t ** a / z for t in tokens]


def test_exponent_meets_entropy_and_repetition(spark):
    held = totals(spark)
    tokens = [r["tokens"] for r in held.collect()]
    a = mixing.exponent(held, target_entropy=0.9)
    entropy = -sum(w * math.log(w) for w in weights(tokens, a)) / math.log(len(tokens))
    assert entropy == pytest.approx(0.9, abs=1e-6)
    a = mixing.exponent(held, most_epochs=2.0)
    times = [w / t for w, t in zip(weights(tokens, a), tokens)]
    assert max(times) / min(times) == pytest.approx(2.0, abs=1e-5)
    a = mixing.exponent(held, most_epochs=1.5, budget=sum(tokens))
    assert max(w * sum(tokens) / t for w, t in zip(weights(tokens, a), tokens)) == pytest.approx(1.5, abs=1e-5)
    assert mixing.exponent(held, target_entropy=1.0) == pytest.approx(0.0, abs=1e-6)
    assert mixing.exponent(held, target_entropy=0.01) == 1.0


def test_stream_keeps_budgets_and_weights(spark):
    rows, df = corpus(spark)
    got = mixing.mixture(df, most_epochs=2.0, block_tokens=60).collect()
    per, epochs = defaultdict(int), defaultdict(Counter)
    for r in got:
        per[r["source"]] += r["tokens"]
        epochs[r["source"]][r["doc_id"]] += 1
    weight = {r["source"]: r["weight"] for r in got}
    for source, c in epochs.items():
        assert len(c) == COUNTS[source] and max(c.values()) - min(c.values()) <= 1 and max(c.values()) <= 2
        assert abs(per[source] / sum(per.values()) - weight[source]) < 0.04
    # every block but the last holds each source's share, to a document
    last = max(r["block"] for r in got)
    for b in range(last):
        for source, w in weight.items():
            held = sum(r["tokens"] for r in got if r["block"] == b and r["source"] == source)
            assert abs(held - w * 60) <= 8
    # a whole epoch is a permutation of the source; another one has another order
    order = lambda e: [r["doc_id"] for r in sorted((r for r in got if r["source"] == "c" and r["epoch"] == e), key=lambda r: (r["block"], r["position"]))]
    assert len(order(0)) == COUNTS["c"] and order(0) != order(1)


def test_drawn_rows_match_the_stream(spark):
    _, df = corpus(spark)
    for options in ({"most_epochs": 2.0}, {"target_entropy": 0.95, "budget": 500}):
        stream = Counter(r["doc_id"] for r in mixing.mixture(df, **options).collect())
        assert Counter(r["doc_id"] for r in mixing.draw(df, **options).collect()) == stream


def test_awkward_rows(spark):
    rows = awkward(spark)
    got = mixing.draw(rows, most_epochs=2.0)
    assert got.columns == rows.columns
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(r[0], r[1]) for r in awkward_rows()}
    assert mixing.mixture(empty(spark), most_epochs=2.0).count() == 0 == mixing.draw(empty(spark), most_epochs=2.0).count()
