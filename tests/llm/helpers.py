"""Small frames with awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

DOCS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
        # names that the operators use inside
        "node string, tokens string, n string, score string, h string")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward_rows(seed=3):
    rng = random.Random(seed)
    base = words(rng, 120)
    texts = [" ".join(base), " ".join(base), " ".join(base[:119] + ["changed"]),
             " ".join(base[:60]) + "\n" + " ".join(base[60:]), None, None, "", "   \n\t ", "one", "one two", "One TWO",
             "\n".join(["same line of words here"] * 9), " ".join(words(rng, 30_000, 9_000)), "x" * 5_000, "漢字かな交じり文" * 20]
    for _ in range(25):
        t = words(rng, rng.randrange(40, 160))
        texts.append(" ".join(t))
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = "edited"
            texts.append(" ".join(t))
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), len(t or ""), "x", "x", "x", "x", "x")
            for i, t in enumerate(texts)]
    rows.append(rows[0])                       # a repeated row
    rows.append((2, *rows[20][1:]))            # a second text under one id
    rows.append((None, *rows[0][1:]))          # no id
    rows.append((None, None, None, None, None, None, None, None, None, None))
    return rows


def awkward(spark, seed=3):
    return spark.createDataFrame(awkward_rows(seed), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
