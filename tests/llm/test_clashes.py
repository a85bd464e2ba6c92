"""Columns with the names that the operators use inside."""

from tillroll.llm import chat, mixing, toxicity
from tillroll.llm.common import free_name


def test_free_name():
    assert free_name("n", ["a"]) == "__n" and free_name("n", ["__N", "___n"]) == "____n"


def frame(spark):
    names = ["border", "epochs", "part", "p_source", "b_source", "__source", "__epochs", "__border", "__copy", "__n", "score", "__score"]
    rows = [(i, f"words {i} of a text", "a" if i % 3 else "b", *[f"{n}{i}" for n in names]) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names)), rows


def test_mixing_keeps_every_column(spark):
    df, rows = frame(spark)
    out = mixing.draw(df, most_epochs=2.0)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} == set(rows)


def test_scores_give_way_to_no_two_columns(spark):
    df, rows = frame(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    model = toxicity.train(df, labels)
    scored = toxicity.score(df, model)
    assert scored.columns.count("score") == 1 and scored.schema["score"].dataType.simpleString() == "double" and scored.count() == 40
    kept = toxicity.drop_toxic(df, labels, threshold=2.0)
    assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} == set(rows)


def test_a_long_message_is_split_in_one_pass(spark):
    text = "aé漢😀" * 500_000
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", ""), (1, 2, "user", None)], "conv_id int, turn int, role string, text string")
    events = chat.as_events(turns)
    got = {}
    for r in events.orderBy("turn", "seq").collect():
        assert len(r["text"]) <= 512
        got[r["turn"]] = got.get(r["turn"], "") + r["text"]
    assert got == {0: text, 1: "", 2: ""}
