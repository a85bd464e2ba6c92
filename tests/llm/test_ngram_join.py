import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, awkward, awkward_rows, empty, words

from tillroll.llm import ngram_join
from tillroll.llm.ngram_join import jaccard_components, keep_one


def brute(rows, k, percent):
    """(doc_id, set size, least reachable id) per row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        n = min(k, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else doc_id))
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_components_match_brute_force(spark, k, percent):
    got = jaccard_components(awkward(spark), k, percent).collect()
    expected = brute([(r[0], r[1]) for r in awkward_rows()], k, percent)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == expected


def test_near_copies_in_small_blocks_and_crowds(spark, monkeypatch):
    """Chains inside tasks, several blocks and all fragments, on a group where most pairs do not link."""
    monkeypatch.setattr(ngram_join, "CROWD", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(11)
    base = words(rng, 100)
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(50)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df, 3, 88).collect()), key=str)
    expected = brute(rows, 3, 88)
    assert got == expected
    assert 1 < len({c for _, _, c in expected}) < 60


def test_keep_one_leaves_one_of_each_group(spark):
    kept = keep_one(awkward(spark), 5, 80).collect()
    parts = {(r[0], r[1]): r[2] for r in brute([(r[0], r[1]) for r in awkward_rows()], 5, 80)}
    named = [(r["doc_id"], r["text"]) for r in kept if r["doc_id"] is not None and (r["text"] or "").split()]
    assert len(named) == len(set(named))
    groups = {c for (i, n), c in parts.items() if n and i is not None}
    assert {i for i, _ in named} == groups
    assert sum(not (r["text"] or "").split() for r in kept) == sum(not (r[1] or "").split() for r in awkward_rows())
    assert set(kept[0].asDict()) == {c.split()[0] for c in DOCS.split(", ")}


def test_empty(spark):
    assert jaccard_components(empty(spark)).count() == 0
    assert keep_one(empty(spark)).count() == 0


def test_range_counts_bound_the_difference():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 1 << 64, 9000, dtype=np.uint64)
    for n, m, shared in ((600, 600, 590), (3000, 2500, 2000), (5000, 4000, 0), (4000, 4000, 4000)):
        a, b = np.sort(hashes[:n]), np.sort(hashes[n - shared:n - shared + m])
        apart = len(np.setxor1d(a, b))
        assert ngram_join._cells_apart(ngram_join._cells(a), ngram_join._cells(b)) <= apart
        assert apart < 1000 or ngram_join._cells_apart(ngram_join._cells(a), ngram_join._cells(b)) > 0.2 * apart
    assert ngram_join._cells(hashes[:ngram_join.COUNTED - 1]) is None


def test_a_shared_passage_costs_long_texts_one_pair_and_no_count(spark, monkeypatch):
    """Two long texts that share half of their words: one shingle proposes them, range counts rule the link out."""
    rng = random.Random(8)
    long = words(rng, 4000, 10**9)
    rows = [(1, " ".join(long)), (2, " ".join(long[:2000] + words(rng, 2000, 10**9))), (3, "a b c d e f g"), (4, "a b c d e f g h")]
    staged = {}
    put = ngram_join.Staging.put

    def seen(self, df, name):
        out = put(self, df, name)
        staged.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(ngram_join.Staging, "put", seen)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df, 3, 80).collect())
    assert got == brute(rows, 3, 80)
    assert staged["pairs"] == [1, 0]
    assert staged["rest"][0] == 2


def test_long_texts_that_share_a_passage_make_no_pairs(spark, monkeypatch):
    """The bitmaps of long texts are full, so that every pair passed them; the range counts rule all of them out."""
    rng = random.Random(21)
    passage = words(rng, 80, 10**9)
    rows = [(i, " ".join(words(rng, 2000, 10**9) + passage)) for i in range(12)]
    rows.append((12, rows[3][1] + " end"))
    made = []
    put = ngram_join.Staging.put

    def seen(self, df, name):
        out = put(self, df, name)
        if name == "block-pairs":
            made.append(out.count())
        return out
    monkeypatch.setattr(ngram_join.Staging, "put", seen)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df, 5, 80).collect())
    assert got == sorted((i, 2076 + (i == 12), 3 if i == 12 else i) for i in range(13))
    assert made == [0]


def test_a_pair_in_many_runs_leaves_a_task_once():
    n, width = 200, ngram_join.BITMAP_WORDS // 2
    cols = {"token": np.repeat(np.arange(n), 2), "x": np.zeros(2 * n, np.int32), "y": np.zeros(2 * n, np.int32),
            "side": np.zeros(2 * n, np.int32), "node": np.tile([7, 9], n), "comp": np.tile([7, 9], n), "n": np.full(2 * n, 600)}
    cells = pa.array([bytes([4, 5] * 64), bytes([5, 4] * 64)] * n, pa.binary())
    bits = pa.ListArray.from_arrays(pa.array(np.arange(2 * n + 1) * width, pa.int32()), pa.array(np.zeros(2 * n * width, np.int64)))
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols.values()), bits, cells], [*cols, "bits", "cells"])
    out = [r for b in ngram_join._block_pass(80)(iter([batch.slice(i, 50) for i in range(0, 2 * n, 50)])) for r in b.to_pylist()]
    assert out == [{"a": 7, "b": 9}]


def test_coarse_counts_bound_the_difference():
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 1 << 64, 60_000, dtype=np.uint64)
    fold = lambda s: next(ngram_join._coarse_pass(iter([pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array([len(s)]), pa.array([[0]]), pa.array([ngram_join._cells(np.sort(s))], pa.binary())],
        ["node", "n", "bits", "cells"])]))).column("cells")[0].as_py()
    for n, m, shared in ((600, 700, 500), (3000, 2500, 2000), (600, 20_000, 600), (20_000, 20_000, 19_000)):
        a, b = hashes[:n], hashes[n - shared:n - shared + m]
        assert len(fold(a)) <= ngram_join.COARSE
        assert ngram_join._cells_apart(fold(a), fold(b)) <= len(np.setxor1d(a, b))
    assert fold(hashes[:100]) is None and fold(hashes) is None
