"""Neighbour search against brute force: recall, exact scores, ties, copies and crowded cells."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, cell int, id string, point string, bound double"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "x", "y", 1.0) for i, v in rows], schema).repartition(3)


def brute(rows, k, every):
    clean = sorted({(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows
                    if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, v in clean:
        if q % every == 0 and q not in out:
            scores = {}
            for i, w in clean:
                if i != q:
                    dot = sum(a * b for a, b in zip(v, w))
                    s = dot / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(a * a for a in w))
                    scores[i] = max(s, scores.get(i, -2))
            out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def run(df, every=5, k=5):
    out = {}
    for r in sorted(ann.nearest(df, F.col("vec_id") % every == 0, k).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9)


def recall(got, want):
    pairs = {(q, i) for q, found in want.items() for i, _ in found}
    return len(pairs & {(q, i) for q, found in got.items() for i, _ in found}) / len(pairs)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_recall_and_scores(spark, monkeypatch, spread):
    monkeypatch.setattr(ann, "CELL_ROWS", 128)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 32))
    rows = [(i, (centres[i % 12] + spread * rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(1500)]
    got, want = run(frame(spark, rows)), brute(rows, 5, 5)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    exact = {(q, i): s for q, found in brute(rows, 1500, 5).items() for i, s in found}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, found in got.items() for i, s in found)


def test_copies_ties_and_a_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 64)
    rng = np.random.default_rng(2)
    hot = rng.standard_normal(8).astype(np.float32)
    rows = [(i, hot.tolist() if i % 3 == 0 else rng.standard_normal(8).astype(np.float32).tolist()) for i in range(600)]
    # near copies crowd one cell beyond its size, all different
    rows += [(1000 + i, (hot + np.float32(1e-4) * rng.standard_normal(8).astype(np.float32)).tolist()) for i in range(400)]
    got, want = run(frame(spark, rows)), brute(rows, 5, 5)
    assert recall(got, want) >= 0.95
    for q in range(0, 600, 15):  # a copy's neighbours are the copies of least id, itself left out
        assert [i for i, _ in got[q]] == [i for i in range(0, 600, 3) if i != q][:5]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (10, [-1.0]), (10, [0.0, -1.0]),
            (3, None), (4, []), (20, [0.0, 0.0]), (25, [nan, 1.0]), (30, [inf, 1.0]), (35, [None, 1.0]), (None, [1.0, 2.0]), (40, [1e-30, 1e30]),
            (45, [1.0, 2.0, 0.0, 0.0])]
    got, want = run(frame(spark, rows), k=4), brute([(i, v and [*v, 0.0, 0.0, 0.0][:4]) for i, v in rows], 4, 5)
    same(got, want)
    assert got[0][0] == (1, 1.0) and 5 not in [i for i, _ in got[5]]


def test_doubles_of_any_size(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, -1e200])]
    got = run(frame(spark, rows, SCHEMA.replace("array<float>", "array<double>")), k=2)
    assert got[0] == [(1, pytest.approx(1.0)), (2, pytest.approx(0.0))]


def test_few_and_no_rows(spark):
    assert run(frame(spark, [])) == {}
    assert run(frame(spark, [(1, [1.0]), (2, [1.0])])) == {}
    assert run(frame(spark, [(5, [1.0, 2.0])])) == {}
    assert [i for i, _ in run(frame(spark, [(5, [1.0, 2.0]), (6, [2.0, 1.0])]))[5]] == [6]


def test_setting_is_restored(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    run(frame(spark, [(0, [1.0, 2.0]), (6, [2.0, 1.0])]))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_stopping_factor_is_the_chi_square_quantile():
    rng = np.random.default_rng(3)
    draws = (rng.standard_normal((400_000, ann.DIMS)) ** 2).sum(axis=1)
    assert np.mean(draws > ann.stopping_factor()) == pytest.approx(ann.MISS, abs=0.002)
