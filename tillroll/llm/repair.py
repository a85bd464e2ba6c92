"""Repair of damaged conversations: Knuth's lightest derivation over weighted deductions.

A conversation's rows in order are edited until the initials of its roles read
``(s?(ua)+)?``: an optional system row, then user and assistant in turns, or
nothing.  Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2 (forced
for blank and duplicate rows), Insert an empty user or assistant row 5; a truncated
row that stays adds 5.  Of the cheapest edits those with the ASCII-least initials
(the audit) count.

**Deductions.**  An item (i, p, q) states that the first i rows of a block take
the grammar from state p to state q; an edit is a rule that leads from one item to the
next.  The agenda pops items by (cost, rows read, audit).  This is a monotone
superior function: an edit never lowers cost, and one without cost reads a row.
Equal costs over the same rows never tie with one audit a prefix of another, since an
audit fixes its cost, so what is lightest stays lightest whatever follows.

**Long conversations** are cut into blocks of at most ``BLOCK_ROWS`` rows.  A
block's items for all pairs of states are derived on their own; then up to
``FAN_IN`` neighbouring blocks at a time are put together by the same agenda, whose
rules are now the items of the blocks.  No task holds the rows of a whole conversation;
only its audit, a character a row, which is a value of the result.  The repaired
text is hashed as a stream in row order.

Defined results: a null text or role, or a null turn or conversation in the key that
picks the damage, counts as one space; null turns stand first; rows of one turn stand by
role and text; a repeated row counts as often as it occurs; a role that starts
with none of ``s``, ``u``, ``a`` must be reroled or deleted; an empty table gives no
rows.  Other columns are ignored under any name.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.common import Staging, bounded_batches

BLOCK_ROWS = 512
FAN_IN = 64

# Grammar states: before anything, after the system row, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# (cost, audit, plan): the plan has, for each character of the audit, the role put out ("-": none).
Item = tuple[int, str, str]
Rules = Callable[[int, int], Iterator[tuple[int, int, Item]]]


def lightest(rows: int, start: int, rules: Rules) -> dict[int, Item]:
    """The lightest item per state after all ``rows``, from ``start`` before them."""
    agenda: list[tuple[int, int, str, str, int]] = [(0, 0, "", "", start)]
    done: set[tuple[int, int]] = set()
    goals: dict[int, Item] = {}
    while agenda:
        cost, at, audit, plan, state = heapq.heappop(agenda)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == rows:
            goals[state] = (cost, audit, plan)
        for ahead, to, (more, letters, roles) in rules(at, state):
            if (ahead, to) not in done:
                heapq.heappush(agenda, (cost + more, ahead, audit + letters, plan + roles, to))
    return goals


def _row_rules(initials: str, faults: str) -> Rules:
    def rules(at: int, state: int) -> Iterator[tuple[int, int, Item]]:
        for role in "ua":
            to = STEP.get((state, role))
            if to is not None:
                yield at, to, (INSERT, "I", role)
        if at == len(initials):
            return
        yield at + 1, state, (DELETE, "D", "-")
        if faults[at] in "bd":
            return
        extra = TRUNCATED if faults[at] == "t" else 0
        for role in "sua":
            to = STEP.get((state, role))
            if to is not None and role == initials[at]:
                yield at + 1, to, (KEEP + extra, "K", role)
            elif to is not None and role != "s":
                yield at + 1, to, (REROLE + extra, "R", role)

    return rules


@lru_cache(maxsize=4096)
def block_items(initials: str, faults: str) -> list[tuple[int, int, Item]]:
    """All items over a block of rows: ``(from state, to state, (cost, audit, plan))``."""
    rules = _row_rules(initials, faults)
    return [(p, q, item) for p in range(4) for q, item in lightest(len(initials), p, rules).items()]


def joined_items(parts: list[list[tuple[int, int, Item]]]) -> list[tuple[int, int, Item]]:
    """The items over neighbouring blocks from the items of each."""
    by_state: list[dict[int, list[tuple[int, Item]]]] = []
    for items in parts:
        step: dict[int, list[tuple[int, Item]]] = {}
        for p, q, item in items:
            step.setdefault(p, []).append((q, item))
        by_state.append(step)

    def rules(at: int, state: int) -> Iterator[tuple[int, int, Item]]:
        if at < len(by_state):
            for q, item in by_state[at].get(state, ()):
                yield at + 1, q, item

    return [(p, q, item) for p in range(4) for q, item in lightest(len(parts), p, rules).items()]


_WHITE = "[\\x20\\x09-\\x0D]"
_ITEMS = "array<struct<p:int,q:int,cost:bigint,audit:string,plan:string>>"
_ITEM_TYPE = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("plan", pa.string())]))
_BLOCK = f"conv string, block bigint, n bigint, first string, last string, illegal bigint, items {_ITEMS}"
_BLOCK_TYPE = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("first", pa.string()), ("last", pa.string()),
                         ("illegal", pa.int64()), ("items", _ITEM_TYPE)])
_LEGAL = {"su", "ua", "au"}


def _as_structs(items: list[tuple[int, int, Item]]) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a, "plan": r} for p, q, (c, a, r) in items]


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of each block from its codes, two characters a row: role initial and fault."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            initials, faults = row["codes"][0::2], row["codes"][1::2]
            out.append({"conv": row["conv"], "block": row["block"], "n": len(initials), "first": initials[0], "last": initials[-1],
                        "illegal": sum(initials[i:i + 2] not in _LEGAL for i in range(len(initials) - 1)),
                        "items": _as_structs(block_items(initials, faults))})
        yield pa.RecordBatch.from_pylist(out, _BLOCK_TYPE)


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            parts = row["parts"]
            items = joined_items([[(i["p"], i["q"], (i["cost"], i["audit"], i["plan"])) for i in part["items"]] for part in parts])
            seams = sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(parts, parts[1:]))
            yield pa.RecordBatch.from_pylist([{
                "conv": row["conv"], "block": row["block"], "n": sum(p["n"] for p in parts), "first": parts[0]["first"],
                "last": parts[-1]["last"], "illegal": seams + sum(p["illegal"] for p in parts), "items": _as_structs(items)}], _BLOCK_TYPE)


def _hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by conversation and place, hashed as one newline-joined text per conversation."""
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    conv, digest, begun = None, hashlib.sha256(), False
    for batch in batches:
        for row in batch.to_pylist():
            if row["conv"] != conv:
                if conv is not None:
                    yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema)
                conv, digest, begun = row["conv"], hashlib.sha256(), False
            for line in row["lines"]:
                digest.update((b"\n" if begun else b"") + line.encode("utf-8"))
                begun = True
    if conv is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema)


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, place)`` after the damage that each row's key picks.

    ``place`` orders the rows of a turn as they stood before: by role, the text's hash, and the copy.
    """
    kind = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn"))) % 20
    rows = turns.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.where("kind <> 0").withColumn("copy", F.explode(copies))
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.struct("role", F.sha2(F.encode("text", "UTF-8"), 256).alias("h"), "copy").alias("place")))


def _own_fault() -> Column:
    """``b`` blank, ``t`` truncated, ``.`` neither."""
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    ended = F.col("text").rlike(f"(?s)[.!?]{_WHITE}*\\z")
    return F.when(blank, "b").when(~ended, "t").otherwise(".")


def _whole_conversations(blocks: DataFrame, staging: Staging) -> DataFrame:
    """Puts neighbouring blocks together until every conversation has one."""
    within = Window.partitionBy("conv").orderBy("block")
    while (blocks.groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > 1:
        ranked = blocks.withColumn("at", F.row_number().over(within) - 1).withColumn("block", F.floor(F.col("at") / FAN_IN).cast("bigint"))
        parts = ranked.groupBy("conv", "block").agg(
            F.sort_array(F.collect_list(F.struct("at", "n", "first", "last", "illegal", "items"))).alias("parts"))
        blocks = staging.put(parts.mapInArrow(_put_together, _BLOCK), "joined")
    return blocks


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(report, rows)`` for ``turns (conv_id, turn, role, text, place)``, nulls only in ``conv_id`` and ``turn``.

    The report has a row per conversation with rows: counts of faults, cost, audit,
    hash of the repaired text.  The rows hold, in order of ``uid``, each source row's
    fault, its edits and the repaired lines that they give.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    staging = Staging(spark, "repair")
    # Sorted by range, so a long conversation lies in many tasks; the id, once written, is the order.
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("place")]
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = staging.put(turns.withColumn("conv", _or_space("conv_id")).repartitionByRange(spread, *order).sortWithinPartitions(*order)
                       .select("conv", F.monotonically_increasing_id().alias("uid"), "turn", "role", "text"), "rows")
    initial = F.substring("role", 1, 1)
    light = rows.select("conv", "uid", "turn", F.sha2(F.encode(F.concat("role", F.lit("\x00"), "text"), "UTF-8"), 256).alias("said"),
                        F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"), _own_fault().alias("own"))
    repeats = light.groupBy("conv", "said").agg(F.min("uid").alias("first_uid"), F.count("*").alias("times")).where("times > 1").drop("times")
    fault = F.when(F.col("own") == "b", "b").when(F.col("uid") > F.col("first_uid"), "d").otherwise(F.col("own"))
    marked = staging.put(light.join(repeats, ["conv", "said"], "left").select(
        "conv", "uid", "turn", "initial", fault.alias("fault"), F.shiftright("uid", BLOCK_ROWS.bit_length() - 1).alias("block")), "marked")
    codes = (marked.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("uid", "initial", "fault"))).alias("c"))
             .select("conv", "block", F.array_join(F.transform("c", lambda x: F.concat(x["initial"], x["fault"])), "").alias("codes")))
    blocks = staging.put(codes.mapInArrow(_derive, _BLOCK), "blocks")
    whole = _whole_conversations(blocks, staging)

    goals = F.filter("items", lambda i: (i["p"] == START) & i["q"].isin(*FINAL))
    best = F.array_min(F.transform(goals, lambda i: F.struct(i["cost"], i["audit"], i["plan"])))
    chosen = staging.put(whole.select("conv", "illegal", best.alias("best")).select("conv", "illegal", "best.cost", "best.audit", "best.plan"), "chosen")

    # An edit and the role that it gives, two characters each; a row owns the inserts before it, the last row also those behind.
    paired = F.array_join(F.zip_with(F.split("audit", ""), F.split("plan", ""), lambda a, p: F.concat(a, p)), "")
    edits = chosen.select("conv", F.posexplode(F.regexp_extract_all(paired, F.lit("((?:I[ua])*[KRD].(?:(?:I[ua])+$)?)"), 1)).alias("pos", "edits"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("conv", "block", before.alias("start"))
    index = F.row_number().over(Window.partitionBy("conv", "block").orderBy("uid")) - 1
    placed = (marked.withColumn("index", index).join(starts, ["conv", "block"]).withColumn("pos", (F.col("start") + F.col("index")).cast("int"))
              .join(edits, ["conv", "pos"]).select("conv", "uid", "fault", "edits"))
    role = lambda e: F.when(F.substring(e, 2, 1) == "u", "user").otherwise("assistant")
    line = lambda e: (F.when(e.startswith("I"), F.concat(role(e), F.lit(":")))
                      .when(e.startswith("K"), F.concat("role", F.lit(":"), "text"))
                      .when(e.startswith("R"), F.concat(role(e), F.lit(":"), "text")))
    lines = F.filter(F.transform(F.regexp_extract_all("edits", F.lit("(..)"), 1), line), lambda x: x.isNotNull())
    repaired = staging.put(rows.join(placed, ["conv", "uid"]).withColumn("lines", lines), "repaired")
    hashed = (repaired.select("conv", "uid", "lines").repartition("conv").sortWithinPartitions("conv", "uid").select("conv", "lines")
              .mapInArrow(_hash_stream, "conv string, repaired_sha256 string"))
    count = lambda f: F.count_if(F.col("fault") == f)
    spread_of = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    faults = marked.groupBy("conv").agg(F.coalesce(spread_of, F.lit(0)).alias("gaps"), count("b").alias("blank"), count("d").alias("duplicate"),
                                        count("t").alias("truncated"))
    report = faults.join(chosen.drop("plan"), "conv").join(hashed, "conv")
    return report, repaired


def repaired_conversations(turns: DataFrame) -> DataFrame:
    """Damages the turns, repairs them and reports on every conversation, also those without a row left."""
    report, _ = repair(damage(turns))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    named = turns.select(F.col("conv_id").alias("conv_id"), _or_space("conv_id").alias("conv")).distinct()
    return named.join(report, "conv", "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
