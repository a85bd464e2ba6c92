"""Chat formatting by event-sourced reconstruction.

A log holds events ``(conv_id, seq, kind, turn, role, text)``.  Folded in the
order of ``seq``, they give a conversation's final messages:

* ``delta`` appends its text to the turn;
* ``edit`` replaces the turn's text;
* ``regenerate`` empties the turn, to be streamed anew;
* ``delete`` removes the turn.

An edit, regeneration or deletion also retires what was said after it so far:
events of higher turns with a lower ``seq`` no longer count.  Delivery is
at least once: an event that repeats in every column counts once.  Different
events of equal ``seq`` are ordered by kind, role and text.  The role of a
message is that of its last event that has one.

Messages are folded by (conversation, turn), so the deltas of a long
conversation spread over tasks; only final messages meet in one row, which is
the formatted string itself.

Template: each message stands between control strings that name its role.
Control strings inside a text are escaped by one backslash more after their
first character and are never read as control strings; taking one backslash
away restores the text, whatever it holds.  ``loss_spans`` are the code points
(from 1, with their number) of the assistant texts.

A log may have a column ``message`` that tells apart messages of one turn;
``as_events`` gives every row its own, so repeated and tied rows are kept.  They
are ordered by role and text.

Nulls: a null text is empty, a null role the role "", a null turn a turn of its own
behind all others (as SQL orders it), a null conversation a conversation of its own.
Events without a known kind count as deltas.  An empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Role -> (opening, closing) control strings; other roles are written out.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[BOT]", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
START = "<s>"
_TAIL = r"(?:/?s>|/?(?:INST|SYS|BOT|ROLE|TEXT)\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_TAIL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_TAIL})", "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """The final messages ``(conv_id, turn, role, text)`` of an event log, with its ``message`` if it has one."""
    own = ["turn", "message"] if "message" in events.columns else ["turn"]
    kind = F.when(F.col("kind").isin("edit", "regenerate", "delete"), F.col("kind")).otherwise("delta")
    event = F.struct("seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.col("role").isNotNull().alias("named"),
                     F.coalesce("text", F.lit("")).alias("text"))
    # collect_set drops repeated deliveries already in the map-side aggregate
    turns = events.groupBy("conv_id", *own).agg(
        F.sort_array(F.collect_set(event)).alias("log"), F.max(F.when(kind != "delta", F.col("seq"))).alias("reset"))
    before = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_last() for c in own]).rowsBetween(Window.unboundedPreceding, -1)
    alive = turns.withColumn("cut", F.max("reset").over(before)).withColumn(
        "log", F.filter("log", lambda e: F.col("cut").isNull() | (e["seq"] > F.col("cut")))).where(F.size("log") > 0)
    # deltas since the last reset, behind that reset's own text
    last = F.aggregate("log", F.struct(F.lit(0).alias("i"), F.lit(0).alias("at")), lambda s, e: F.struct(
        (s["i"] + 1).alias("i"), F.when(e["kind"] != "delta", s["i"] + 1).otherwise(s["at"]).alias("at")))["at"]
    start = F.greatest(F.col("last"), F.lit(1))
    tail = F.slice("log", start, F.size("log") - start + 1)
    text = F.array_join(F.transform(tail, lambda e: F.when(e["kind"] == "regenerate", "").otherwise(e["text"])), "")
    named = F.filter("log", lambda e: e["named"])
    return (alive.withColumn("last", last)
            .where((F.col("last") == 0) | (F.element_at("log", F.greatest("last", F.lit(1)))["kind"] != "delete")
                   | (F.size("log") > F.col("last")))
            .withColumn("text", F.when((F.col("last") > 0) & (F.element_at("log", start)["kind"] == "delete"),
                                       F.array_join(F.transform(F.slice("log", start + 1, F.size("log") - start), lambda e: e["text"]), ""))
                        .otherwise(text))
            .select("conv_id", *own, F.coalesce(F.try_element_at(named, F.lit(-1))["role"], F.lit("")).alias("role"), "text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, loss_spans``."""
    inner = escape(F.col("text"))
    opening, closing = F.concat(F.lit(OTHER[0]), escape(F.col("role")), F.lit(OTHER[1])), F.lit(OTHER[2])
    for role, (a, b) in MARKS.items():
        opening = F.when(F.col("role") == role, a).otherwise(opening)
        closing = F.when(F.col("role") == role, b).otherwise(closing)
    own = ["turn", "message"] if "message" in messages.columns else ["turn"]
    part = F.struct(F.col("turn").isNull().alias("last"), *own, "role", F.concat(opening, inner, closing).alias("body"),
                    F.char_length(opening).alias("lead"), F.char_length(inner).alias("length"))
    joined = (messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
              .withColumn("formatted", F.concat(F.lit(START), F.array_join(F.transform("parts", lambda p: p["body"]), ""))))
    empty = F.array().cast("array<struct<start:int,length:int>>")
    spans = F.aggregate(
        "parts", F.struct(F.lit(len(START)).alias("at"), empty.alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p["body"])).alias("at"),
            F.when(p["role"] == "assistant", F.concat(s["spans"], F.array(F.struct(
                (s["at"] + p["lead"] + 1).alias("start"), p["length"].alias("length"))))).otherwise(s["spans"]).alias("spans")))["spans"]
    return joined.select("conv_id", F.size("parts").cast("bigint").alias("n_turns"), "formatted", spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The messages of a formatted string: ``array<struct<role, text>>``."""
    known = "|".join(a[1:-1] for a, _ in MARKS.values())
    pattern = (rf"(?s)\[({known})\](.*?)(?:\[/INST\]|\[/SYS\]|</s>)|\[ROLE\](.*?)\[TEXT\](.*?)\[/ROLE\]")
    group = lambda i: F.regexp_extract_all(formatted, F.lit(pattern), F.lit(i))
    role = lambda m, r: F.coalesce(*[F.when(m == a[1:-1], k) for k, (a, _) in MARKS.items()], unescape(r))
    known_part = F.arrays_zip(group(1).alias("mark"), group(2).alias("body"), group(3).alias("other"), group(4).alias("rest"))
    return F.transform(known_part, lambda z: F.struct(
        role(z["mark"], z["other"]).alias("role"),
        unescape(F.when(z["mark"] != "", z["body"]).otherwise(z["rest"])).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")


def as_events(turns: DataFrame, piece: int = 512) -> DataFrame:
    """A log of finished turns as it would have been streamed: deltas of ``piece`` code points.

    Every row is a message of its own, numbered among those of its turn.
    """
    text = F.coalesce("text", F.lit(""))
    tied = Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), text)
    turns = turns.withColumn("message", F.row_number().over(tied))
    pieces = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)))
    return turns.select("conv_id", "turn", "message", "role", F.posexplode(pieces).alias("i", "text")).select(
        "conv_id", F.struct("turn", "message", "i").alias("seq"), F.lit("delta").alias("kind"), "turn", "message", "role", "text")
