"""Mixing sources to target weights: temperature, budgets, block permutations.

Weights are the sources' token shares raised to an exponent and normalised.
The exponent is found by bisection, one Spark aggregate per round trying
``PROBES`` exponents at once: the largest in [0, 1] (closest to the corpus) at which the
weights' entropy reaches a target, or the smallest (most even) at which no
source is repeated more often than a limit allows.

The mixture is then realised over a token budget.  A source with budget ``b``
and ``t`` tokens is read ``b // t`` times whole, each time in a fresh pseudo-random
permutation (an *epoch*), and once in part, up to the first document that
reaches the budget.  The default budget, ``"cover"``, is the least at which every source
is read whole at least once, so no document is lost.  The stream is cut into blocks of
``block_tokens``; in each, every source holds its weight's share, and a block's documents
are permuted.

Token sums run over hashed slots of each source, so a source with a third of
all rows is ordered by many tasks.  Rows of the result: one per document and
epoch.  A null source is a source of its own; null and empty texts count one
token, so that they are drawn too.  Repeated rows are drawn each.  An empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import free_name, Staging

PROBES = 32
ROUNDS = 6
SLOTS = 4096
SEED = 17


def token_count(text: Column) -> Column:
    """Words of a text, at least one."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("bigint")


def shares(counted: DataFrame, staging: Staging) -> DataFrame:
    """``(source, tokens, rows)`` of every source."""
    return staging.put(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "shares")


def _probe(totals: DataFrame, whole: float, exponents: list[float]) -> list[dict]:
    """Entropy and largest repetition of the weights at each exponent; one pass, one row."""
    p = F.col("tokens") / F.lit(whole)
    sums = []
    for i, a in enumerate(exponents):
        sums += [F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}")]
    row = totals.agg(*sums, F.min(p).alias("least"), F.max(p).alias("most")).first()
    out = []
    for i, a in enumerate(exponents):
        z = row[f"z{i}"]
        entropy = math.log(z) - a * row[f"l{i}"] / z
        # epochs are w / p; with the covering budget the rarest reading is one epoch
        rarest, often = row["most"] ** (a - 1), row["least"] ** (a - 1)
        out.append({"entropy": entropy, "cover": max(often / rarest, rarest / often), "epochs": max(often, rarest) / z})
    return out


def exponent(totals: DataFrame, target_entropy: float | None = None, most_epochs: float | None = None,
             budget: int | str = "cover") -> float:
    """The exponent in [0, 1] that meets the target; 1 leaves the shares as they are.

    ``target_entropy`` is a fraction of the largest possible entropy.
    """
    if (target_entropy is None) == (most_epochs is None):
        raise ValueError("give a target entropy or a repetition limit")
    n, whole = totals.agg(F.count("*"), F.sum("tokens")).first()
    if not whole or n == 1:
        return 1.0
    scale = None if budget == "cover" else budget / whole

    def even_enough(x: dict) -> bool:
        """True on the side of exponent 0 of the border searched."""
        if target_entropy is not None:
            return x["entropy"] >= target_entropy * math.log(n)
        return (x["cover"] if scale is None else x["epochs"] * scale) > most_epochs

    low, high = 0.0, 1.0
    ends = _probe(totals, float(whole), [low, high])
    if not even_enough(ends[0]):
        return low
    if even_enough(ends[1]):
        return high
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / (PROBES + 1) for i in range(1, PROBES + 1)]
        side = [even_enough(x) for x in _probe(totals, float(whole), grid)]
        turn = side.index(False) if False in side else PROBES
        low, high = ([low, *grid][turn], [*grid, high][turn])
    return low if target_entropy is not None else high


def plan(totals: DataFrame, a: float, budget: int | str, staging: Staging) -> DataFrame:
    """``(source, tokens, weight, budget, epochs)``: whole epochs and the tokens of the part read last."""
    whole, most = totals.agg(F.sum("tokens"), F.max("tokens")).first()
    p = F.col("tokens") / F.lit(float(whole or 1))
    z = totals.agg(F.sum(F.pow(p, F.lit(a)))).first()[0] or 1.0
    weight = F.pow(p, F.lit(a)) / F.lit(z)
    if budget == "cover":
        # the source with the largest share is read least often: once
        total = F.lit(float(most or 1)) / (F.lit(((most or 1) / (whole or 1)) ** a) / F.lit(z))
    else:
        total = F.lit(float(budget))
    wanted = F.round(weight * total).cast("bigint")
    return staging.put(
        totals.select("source", "tokens", weight.alias("weight"), wanted.alias("budget"))
        .withColumn("epochs", F.expr("budget div tokens")).withColumn("part", F.col("budget") % F.col("tokens")), "plan")


def _order(epoch: Column) -> Column:
    return F.xxhash64("doc_id", "text_hash", epoch, F.lit(SEED))


def _slot(h: Column) -> Column:
    """Slots follow the order of the hash, so a slot's rows are neighbours in the permutation."""
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 64 - int(math.log2(SLOTS))).cast("int")


def _positions(drawn: DataFrame, staging: Staging) -> DataFrame:
    """Adds ``before``: the tokens of the same source and epoch that come earlier."""
    drawn = drawn.withColumn("h", _order(F.col("epoch"))).withColumn("slot", _slot(F.col("h")))
    slots = staging.put(drawn.groupBy("source", "epoch", "slot").agg(F.sum("tokens").alias("s")), "slots")
    w = Window.partitionBy("source", "epoch").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select(F.col("source").alias("s_source"), F.col("epoch").alias("s_epoch"), F.col("slot").alias("s_slot"),
                          F.coalesce(F.sum("s").over(w), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "epoch", "slot").orderBy("h", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    return (drawn.withColumn("own", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
            .join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("epoch") == F.col("s_epoch"))
                  & (F.col("slot") == F.col("s_slot")))
            .withColumn("before", F.col("start") + F.col("own"))
            .drop("s_source", "s_epoch", "s_slot", "start", "own"))


def _counted(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       token_count(F.col(text_col)).alias("tokens"), F.xxhash64(text_col).alias("text_hash"))


def mixture(docs: DataFrame, target_entropy: float | None = None, most_epochs: float | None = None,
            budget: int | str = "cover", block_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source") -> DataFrame:
    """The mixed stream: ``doc_id, source, tokens, epoch, weight, block, position``.

    ``position`` orders a block's rows; it is a hash, with ties by source, epoch and id.
    """
    staging = Staging(docs.sparkSession, "mixing")
    counted = staging.put(_counted(docs, id_col, text_col, source_col), "counted")
    totals = shares(counted, staging)
    a = exponent(totals, target_entropy, most_epochs, budget)
    sources = plan(totals, a, budget, staging).select(
        F.col("source").alias("p_source"), F.col("tokens").alias("whole"), "weight", "epochs", "part")
    last = F.when(F.col("part") > 0, F.col("epochs")).otherwise(F.col("epochs") - 1).cast("int")
    drawn = (counted.join(sources, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
             .where(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), last))))
    placed = (_positions(drawn, staging)
              .where((F.col("epoch") < F.col("epochs")) | (F.col("before") < F.col("part"))))
    stream = F.col("epoch") * F.col("whole") + F.col("before")
    return (placed.withColumn("block", F.floor(stream / (F.col("weight") * block_tokens)))
            .withColumn("position", F.xxhash64("doc_id", "text_hash", "epoch", "block", F.lit(SEED)))
            .select("doc_id", "source", "tokens", "epoch", "weight", "block", "position"))


def draw(docs: DataFrame, target_entropy: float | None = None, most_epochs: float | None = None,
         budget: int | str = "cover", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` mixed: each row as often as it is drawn, same columns.

    Texts are not shuffled: the last, partial epoch of a source is all rows
    before one border in its permutation, and the borders are a small table.
    """
    staging = Staging(docs.sparkSession, "mixing")
    counted = staging.put(_counted(docs, id_col, text_col, source_col), "counted")
    totals = shares(counted, staging)
    a = exponent(totals, target_entropy, most_epochs, budget)
    sources = plan(totals, a, budget, staging).select(F.col("source").alias("p_source"), "epochs", "part")
    partial = (counted.join(sources.where("part > 0"), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
               .withColumn("epoch", F.col("epochs").cast("int")))
    borders = (_positions(partial, staging).where(F.col("before") < F.col("part"))
               .groupBy("source").agg(F.max(F.struct("h", "doc_id", "text_hash")).alias("border"))
               .select(F.col("source").alias("b_source"), "border"))
    # names that no column of the documents has
    source, epochs, border, copy = (free_name(n, docs.columns) for n in ("source", "epochs", "border", "copy"))
    known = staging.put(sources.join(borders, F.col("p_source").eqNullSafe(F.col("b_source")), "left").select(
        F.col("p_source").alias(source), F.col("epochs").alias(epochs), F.col("border").alias(border)), "borders")
    here = F.struct(F.xxhash64(docs[id_col], F.xxhash64(docs[text_col]), F.col(epochs).cast("int"), F.lit(SEED)).alias("h"),
                    docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"))
    times = (F.col(epochs) + F.when(F.col(border).isNotNull() & (here <= F.col(border)), 1).otherwise(0)).cast("int")
    return (docs.join(known, docs[source_col].eqNullSafe(F.col(source)))
            .withColumn(copy, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*[docs[c] for c in docs.columns]))
