"""Collocations against plain counting, on awkward rows and on skewed ones."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import awkward, empty
from tillroll.llm import collocation
from tillroll.llm.collocation import collocations

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, support, top, percent=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) >= 2 and a >= support}
        gone = {p[i:i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                if 100 * a >= percent * cand[p[i:i + m]]}
        found = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        found.sort()
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(found[:top])]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in collocations(df, **options).collect())


@pytest.mark.parametrize("support, top, percent", [(3, 50, 100), (8, 2000, 100), (5, 2000, 60)])
def test_matches_plain_counting(spark, support, top, percent):
    df = awkward(spark)
    rows = [(r.lang, r.text) for r in df.collect()]
    got = found(df, support=support, top=top, inside_percent=percent)
    assert got and got == brute(rows, support, top, percent)


def test_pieces_words_and_case(spark):
    texts = ["A b\tc. D e", "a  b\x0bc d É é", "a b! a b? a b: a,b;a b", ". , ;", "漢字 かな 漢字 かな", "\x0c\r\n a b c d e f g"]
    rows = [(i, t, lang) for i, t in enumerate(texts * 4) for lang in ("en", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert found(df, support=4) == brute([(r[2], r[1]) for r in rows], 4, 2000)


def test_a_third_of_the_rows_equal_and_one_very_long_text(spark):
    rng = random.Random(5)
    same = " ".join(f"w{i % 37}" for i in range(80)) + "."
    rows = [(i, same if i % 3 == 0 else " ".join(rng.choice("abcdefgh") for _ in range(30)), "en") for i in range(400)]
    rows.append((1000, " ".join(f"v{rng.randrange(50)}" for _ in range(200_000)), "en"))
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(7)
    assert found(df, support=100) == brute([(r[2], r[1]) for r in rows], 100, 2000)


def test_shards_and_runs_do_not_change_the_result(spark, monkeypatch):
    df = awkward(spark)
    whole = found(df, support=4)
    assert found(df, support=4, shards=1) == whole == found(df, support=4, shards=3)
    monkeypatch.setattr(collocation, "RUN", 500)
    monkeypatch.setattr(collocation, "CHUNK_BYTES", 300)
    assert found(df, support=4) == whole


def test_products_past_64_bits():
    """The score's numerator at the size of a large corpus, as the plan computes it."""
    a, n, part = 3 * 10**9, 10**13, 4 * 10**9
    assert 1000 * a * n > 2**63 and 1000 * a * n // (part * part) == 1_875_000


def test_wide_products_in_the_plan(spark):
    df = spark.range(1).selectExpr(
        "cast(3000000000 as decimal(19,0)) as a", "cast(10000000000000 as decimal(19,0)) as n", "cast(4000000000 as decimal(19,0)) as l")
    up = "cast(a * n as decimal(35,0)) * cast(1000 as decimal(4,0))"
    assert df.selectExpr(f"({up}) div (l * l) as s").first().s == 1_875_000


def test_empty_table(spark):
    assert collocations(empty(spark)).collect() == []
    nulls = spark.createDataFrame([(None, None, None), (1, "", "en")], "doc_id int, text string, lang string")
    assert collocations(nulls, support=1).collect() == []
