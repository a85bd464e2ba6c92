import hashlib

from helpers import awkward, awkward_rows, empty
from pyspark.sql import functions as F

from tillroll.llm import fingerprint as fp


def test_edits_and_likeness(spark):
    rows = sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in awkward_rows()))
    got = fp.edited_neighbours(awkward(spark)).collect()
    expected = []
    for i, (doc_id, text) in enumerate(rows):
        k = len(text) // 2
        edited = text[:len(text) - k] + rows[(i + 1) % len(rows)][1][:k]
        expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(expected)
    texts = {hashlib.sha256(t.encode()).hexdigest() for _, t in rows}
    assert len({r["fingerprint"] for r in got}) == len(texts)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert all(r["near_edited"] == 1 for r in got if r["fingerprint"] == r["edited_fingerprint"])


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["id"]: r for r in fp.fingerprints(df).collect()}


def test_order_independent_and_homomorphic(spark):
    got = prints(spark, ["a b c d\ne f\n\ng", "g\n\ne f\na b c d", "a b c d\ne f", "\ng", "a b c d\ne f\ng", None, ""])
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != got[4]["fingerprint"]
    assert got[5]["fingerprint"] == got[6]["fingerprint"]
    pair = spark.createDataFrame([(got[2]["lanes"], got[3]["lanes"], got[0]["lanes"])], "a array<int>, b array<int>, c array<int>")
    row = pair.select(fp.combine(F.col("a"), F.col("b")).alias("sum"), fp.combine(F.col("c"), F.col("b"), -1).alias("less")).first()
    assert row["sum"] == got[0]["lanes"] and row["less"] == got[2]["lanes"]


def test_likeness_follows_the_shared_share(spark):
    w = [f"t{i}" for i in range(600)]
    got = prints(spark, [" ".join(w), " ".join(w[:450]), " ".join(w[:150]), " ".join(f"u{i}" for i in range(600))])
    df = spark.createDataFrame([(got[0]["lanes"], got[i]["lanes"]) for i in range(4)], "a array<int>, b array<int>")
    near = [r[0] for r in df.select(fp.likeness("a", "b")).collect()]
    assert near[0] == 1 and abs(near[1] - 0.75) < 0.12 and abs(near[2] - 0.25) < 0.2 and near[3] < 0.2


def test_no_python_in_the_plan_and_one_shuffle_of_texts(spark):
    plan = fp.edited_neighbours(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert plan.count("hashpartitioning(range") == 1


def test_empty_and_single(spark):
    assert fp.edited_neighbours(empty(spark)).count() == 0
    one = fp.edited_neighbours(spark.createDataFrame([(5, "alone here")], "doc_id bigint, text string")).first()
    assert one["n_chars"] == 10 and one["near_next"] == 1


def test_likeness_of_texts_beyond_the_16_bit_counts(spark):
    """Half in common; sizes past 2^16 and 2^17, and a line repeated past 2^15 times."""
    text = lambda n, of="t": " ".join(f"{of}{i}" for i in range(n))
    line = "one two three\n"
    got = prints(spark, [text(70_000), text(35_000), text(140_000), line * 70_000, line * 35_000])
    df = spark.createDataFrame([(got[a]["lanes"], got[b]["lanes"]) for a, b in ((0, 1), (0, 2), (3, 4))], "a array<bigint>, b array<bigint>")
    half, twice, lines = [r[0] for r in df.select(fp.likeness("a", "b")).collect()]
    assert got[0]["lanes"][-1] == 69_998 and got[2]["lanes"][-1] == 139_998 and got[3]["lanes"][-1] == 70_000
    assert abs(half - 0.5) < 0.12 and abs(twice - 0.5) < 0.12 and lines == 0


def test_no_number_of_repeats_vanishes(spark):
    got = prints(spark, ["a", "a" + "\n" * 65_536, "b c", "b c" + "\n" * 131_072, "b c" + "\nx" * 65_536, "b c" + "\ny" * 65_536])
    assert len({r["fingerprint"] for r in got.values()}) == 6


def test_the_hashes_of_a_paragraph_are_independent(spark):
    """Lanes of different seeds must not be functions of one 64-bit hash: no pair of lanes decides another."""
    rows = prints(spark, [f"p{i}" for i in range(400)])
    lanes = [r["lanes"][:fp.EXACT] for r in rows.values()]
    for i in range(4):
        for j in range(i + 1, 4):
            agree = sum((x[4 * i] ^ x[4 * j]) & 255 == (lanes[0][4 * i] ^ lanes[0][4 * j]) & 255 for x in lanes)
            assert agree < 20
