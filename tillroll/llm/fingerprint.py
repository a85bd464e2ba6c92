"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A text's paragraphs (split at line feeds, empty ones included) are hashed to
wide vectors, and a fingerprint is the lane-wise sum of them, so it does not depend
on the paragraphs' order, and a paragraph is inserted or deleted by adding or
subtracting its vector.  A vector has three parts:

* ``EXACT`` lanes of 16 bits hashed from the whole paragraph, which decide
  equality (256 bits from four hashes with seeds of their own);
* ``LIKE`` lanes that add up one bit per three-word shingle of the paragraph
  (fewer words: the whole paragraph), which estimate likeness;
* one lane that counts the shingles.

All lanes are sums modulo 2^32: a text holds fewer than 2^31 paragraphs and 2^30
shingles, so no number of repeats brings a lane back to where it was, and neither the
count nor a signed difference of two texts wraps.

With ``n`` shingles and bit sums ``s`` a lane's signed sum is ``2 s - n``.  The
difference of two such sums has, over the lanes, a mean square equal to the
squared distance ``d`` of the two shingle multisets in expectation, so the
likeness is ``(n1 + n2 - d) / (n1 + n2 + d)``, cut to [0, 1]: an estimate of the
multisets' Jaccard similarity.  Equal fingerprints have likeness 1.

Everything is built from DataFrame functions.  Null texts count as empty.
Repeated rows and equal ids get a row each.  An empty table gives no rows.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = 16
LIKE = 64
LANE = 1 << 16
WIDE = 1 << 32
SHINGLE = 3
ROWS_PER_RANGE = 256
MOST_RANGES = 1 << 16

_HALF = (1 << 31) + 1  # two one-bit lanes, 31 bits apart: no sum of a text's shingles carries over
_LIKE_SUMS = [f"l{i}" for i in range(LIKE // 2)]
_EXACT_SUMS = [f"e{i}" for i in range(EXACT)]


def _shingles() -> Column:
    """Hashes of the runs of three ``words``; of all of them when there are fewer."""
    at = lambda i: F.element_at(F.col("words"), i)
    n = F.size("words")
    runs = F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.xxhash64(*[at(i + j) for j in range(SHINGLE)]))
    short = F.array(F.xxhash64(F.concat_ws(" ", "words"), F.lit("short")))
    return F.when(n >= SHINGLE, runs).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))


def vectors(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Lane sums of ``text`` per row; ``keys`` must tell the rows apart.

    ``l*`` hold two LIKE lanes each, ``e*`` one EXACT lane, ``n`` the shingles.
    """
    paragraphs = texts.select(*keys, F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("paragraph"))
    words = F.filter(F.split("paragraph", "[ \\t\\x0B\\f\\r]+"), lambda w: w != "")
    units = (paragraphs.withColumn("words", words)
             .select(*keys, "paragraph", F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), _shingles())).alias("unit", "h")))
    whole, part = F.col("unit") == 0, F.col("unit") > 0
    # 16 bits of each of the paragraph's hashes per EXACT lane, only once per paragraph
    # the seed goes first: behind the paragraph it would only continue from one and the same 64 bits
    hashes = [F.when(whole, F.xxhash64(F.lit(i), F.col("paragraph"))) for i in range(EXACT // 4)]
    units = units.select(*keys, "unit", "h", *[h.alias(f"x{i}") for i, h in enumerate(hashes)])
    like = [F.sum(F.when(part, F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_HALF))).otherwise(F.lit(0).cast("bigint"))).alias(c)
            for i, c in enumerate(_LIKE_SUMS)]
    exact = [F.sum(F.when(whole, F.shiftrightunsigned(f"x{i // 4}", 16 * (i % 4)).bitwiseAND(F.lit(LANE - 1)))
                   .otherwise(F.lit(0).cast("bigint"))).alias(c) for i, c in enumerate(_EXACT_SUMS)]
    return units.groupBy(*keys).agg(*like, *exact, F.sum(part.cast("bigint")).alias("n"))


def lanes() -> Column:
    """The fingerprint's lanes from the sums, modulo 2^32."""
    like = [x for c in _LIKE_SUMS for x in (F.col(c).bitwiseAND((1 << 31) - 1), F.shiftrightunsigned(c, 31))]
    return F.transform(F.array(*[F.col(c) for c in _EXACT_SUMS], *like, F.col("n")), lambda x: F.pmod(x, F.lit(WIDE)))


def as_text(lanes_col: str) -> Column:
    """Eight hexadecimal digits per lane."""
    return F.array_join(F.transform(lanes_col, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint lanes after adding (or, with -1, taking away) paragraphs' lanes ``b``."""
    return F.transform(a, lambda x, i: F.pmod(x.cast("bigint") + sign * F.get(b, i).cast("bigint"), F.lit(WIDE)))


def likeness(a: str, b: str) -> Column:
    """Estimated similarity in [0, 1] of two lane arrays."""
    signed = lambda x: F.pmod(x + F.lit(WIDE // 2), F.lit(WIDE)) - WIDE // 2
    na, nb = F.element_at(a, -1).cast("bigint"), F.element_at(b, -1).cast("bigint")
    part = lambda c: F.slice(c, EXACT + 1, LIKE)
    gap = F.zip_with(part(a), part(b), lambda x, y: signed(2 * (x.cast("bigint") - y) - (na - nb)).cast("double"))
    d = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) / LIKE
    size = (na + nb).cast("double")
    raw = F.when(size + d > 0, (size - d) / (size + d)).otherwise(0.0)
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, lanes)`` of every row; rows with equal id and text share theirs."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.groupBy("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).agg(
        F.first("text").alias("text"), F.count("*").alias("copies"))
    summed = vectors(keyed, ["id", "h1", "h2", "copies"])
    return (summed.withColumn("lanes", lanes()).withColumn("fingerprint", as_text("lanes"))
            .select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "id", "fingerprint", "lanes").drop("col"))


def _range_starts(ids: DataFrame) -> list[int]:
    """Ascending ids that begin the ranges; bounded by ``MOST_RANGES``."""
    least, rows = ids.agg(F.min("id"), F.count("*")).first()
    if not rows:
        return [0]
    ranges = max(1, min(MOST_RANGES, math.ceil(rows / ROWS_PER_RANGE)))
    points = [i / ranges for i in range(1, ranges)]
    found = ids.agg(F.percentile_approx("id", points, 8 * ranges).alias("q")).first()["q"] if points else []
    return sorted({least, *(found or [])})


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, its edited form and its successor by id, fingerprinted and compared.

    The edited text replaces the last half (rounded down) of the code points by
    as many first ones (or all) of the next text in ascending id; the last row's
    next is the first.  Rows are dealt by id range with the first row of each
    following range added, so every task orders a bounded share and the texts
    are shuffled once.  Ties of the id are ordered by the text.
    """
    least_long = -(1 << 63)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.coalesce(F.col(id_col).cast("bigint"), F.lit(least_long)).alias("id"))
    starts = _range_starts(base.select("id"))
    bounds = F.lit(starts).cast("array<bigint>")
    own = _last_not_above(bounds, len(starts), F.col("id"))
    n = len(starts)
    ranged = base.withColumn("own", own)
    head = F.col("id") == F.element_at(bounds, F.col("own") + 1)
    before = F.pmod(F.col("own") - 1, F.lit(n)).cast("int")
    here, extra = (F.struct(x.alias("range"), F.lit(f).alias("extra")) for x, f in ((F.col("own"), 0), (before, 1)))
    dealt = (ranged.withColumn("to", F.explode(F.when(head, F.array(here, extra)).otherwise(F.array(here))))
             .select("to.range", "to.extra", "id", "doc_id", "text"))
    w = Window.partitionBy("range").orderBy("extra", "id", "text")
    chars = F.char_length("text")
    cut = F.floor(chars / 2).cast("int")
    rows = (dealt.withColumn("next_text", F.lead("text").over(w)).withColumn("at", F.row_number().over(w))
            .withColumn("n_chars", chars.cast("bigint"))
            .withColumn("edited", F.when(F.col("extra") == 0, F.concat(
                F.expr("substring(text, 1, cast(char_length(text) - floor(char_length(text) / 2) as int))"),
                F.when(cut > 0, F.expr("substring(next_text, 1, cast(floor(char_length(text) / 2) as int))")).otherwise(""))))
            .withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)))
    keys = ["range", "at", "extra", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.explode(F.when(F.col("extra") == 0, F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"))))
        .otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"))))).alias("t")
        ).select(*keys, "t.kind", "t.text")
    summed = vectors(both, [*keys, "kind"]).select(*keys, "kind", lanes().alias("lanes"))
    paired = summed.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("lanes"))).alias("own_lanes"),
                                       F.max(F.when(F.col("kind") == 1, F.col("lanes"))).alias("edited_lanes"))
    follow = Window.partitionBy("range").orderBy("at")
    return (paired.withColumn("next_lanes", F.lead("own_lanes").over(follow)).where("extra = 0")
            .select("doc_id", "n_chars", "edited_sha256", as_text("own_lanes").alias("fingerprint"),
                    as_text("edited_lanes").alias("edited_fingerprint"),
                    likeness("own_lanes", "edited_lanes").alias("near_edited"),
                    likeness("own_lanes", "next_lanes").alias("near_next")))


def _last_not_above(bounds: Column, n: int, value: Column) -> Column:
    """Index of the last of ``n`` sorted bounds that is <= ``value``, by halving steps."""
    steps = [1 << i for i in reversed(range((n - 1).bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(
        (at + step < n) & (F.element_at(bounds, F.least(at + step, F.lit(n - 1)) + 1) <= value), at + step).otherwise(at))
