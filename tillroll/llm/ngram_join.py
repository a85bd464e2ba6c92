"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets
of distinct ``k``-word shingles (64-bit hashes of lower-cased words).  The join
runs in these steps, all of them Spark jobs whose tasks see bounded state:

1. *Sets.*  One pass gives every document its set size, a hash of the whole
   set (its ``node``: copies share one), a 1,024-bit parity bitmap and, for
   sets that saturate it, the number of shingles in each of many hash ranges (two
   to four shingles wide).  The same pass counts shingles that recur inside a task; the most frequent ones
   (a table of bounded length) are moved to the end of the global order.
   The order decides only how much work is done, never the result.
2. *First fragment.*  Linked sets share a shingle among the first
   ``n - ceil(n * percent / 100) + 1`` of the order.  For each such shingle its
   holders are chained, first inside the task that read them, then across
   tasks, so a shingle held by a third of all documents still costs one row
   per holder.  Each node's nearest few partners in the chains, verified as in
   step 3, give first components.  The chain follows the sets' sizes: where neighbours differ too
   much in size, no pair across that gap can link.
3. *Fragments.*  The hash range is cut into fragments.  For each candidate
   pair and fragment the overlap is counted on its own; the sum per pair
   decides.  Pairs whose sizes, bitmaps or range counts rule a link out are not counted.
4. *Rest.*  Shingles whose holders are not yet in one component are read
   again, of shingles with the same holders (a passage that two texts share) one
   only, and every pair of holders from different components that sizes,
   bitmaps and range counts (folded to at most 512 ranges) allow is verified as in step 3.  Pairs inside a component need no
   test: they can't change any component.  Blocks of holders are compared with
   one another, so no task holds a whole group.

Nulls, empty and white-only texts have an empty set, link with nothing and
form their own component.  Repeated rows and equal ids are kept row by row; a
component's id is the least non-null id of its rows.  Columns other than the
id and the text are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm import tokens
from tillroll.llm.common import Staging, bounded_batches, components

BITMAP_WORDS = 16          # 64 bits each
FRAGMENTS = 8              # equal ranges of the hash order
FREQUENT = 1 << 20         # entries of the frequent-shingle table
FLUSH = 1 << 21            # shingles a task counts at once
CROWD = 64                 # holders of one shingle that a task chains itself
NEAREST = 3                # partners per node that form the first components
BLOCK = 1024               # holders of one shingle compared at once
COUNTED = 512              # shingles from which a set counts them by hash range
MOST_RANGE_BITS = 16       # at most so many ranges, as a power of two
COARSE = 512               # ranges that a holder in a block keeps of these counts
COARSE_MOST = 16 * COARSE  # finer counts than these would rule nothing out when folded
FOUND = 1 << 18            # pairs that a task of the block pass holds before it sends them on
FILTER_BITS = 1 << 24      # size of a broadcast membership filter


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _node(shingles: np.ndarray) -> int:
    """64-bit hash of a set, from its sorted shingles."""
    if not len(shingles):
        return 0
    spread = tokens.mix(shingles + np.uint64(len(shingles)))
    return int(tokens.mix(np.array([spread.sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of the bitmap's cells."""
    cells = (shingles >> np.uint64(17)) & np.uint64(64 * BITMAP_WORDS - 1)
    odd = (np.bincount(cells.astype(np.int64), minlength=64 * BITMAP_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _cells(shingles: np.ndarray) -> bytes | None:
    """How many shingles (255 at most) lie in each of equal hash ranges; none for small sets."""
    if len(shingles) < COUNTED:
        return None
    bits = min((len(shingles) - 1).bit_length() - 2, MOST_RANGE_BITS)
    count = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(count, 255).astype(np.uint8).tobytes()


def _folded(cells: bytes, few: int) -> np.ndarray:
    """The counts in ``few`` wider ranges."""
    return np.frombuffer(cells, np.uint8).reshape(few, -1).sum(axis=1, dtype=np.int64)


def _cells_apart(a: bytes, b: bytes) -> int:
    """Sum of the differences by range: the sets' symmetric difference is at least that."""
    few = min(len(a), len(b))
    return int(np.abs(_folded(a, few) - _folded(b, few)).sum())


def _coarse_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Range counts folded to at most ``COARSE`` ranges; none where they are finer than ``COARSE_MOST`` or reach 255."""
    def coarse_of(c: bytes | None) -> bytes | None:
        if c is None or len(c) > COARSE_MOST:
            return None
        wide = _folded(c, min(len(c), COARSE))
        return wide.astype(np.uint8).tobytes() if wide.max() < 255 else None

    for batch in it:
        coarse = [coarse_of(c) for c in batch.column("cells").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "n", "bits")), pa.array(coarse, pa.binary())],
                                         ["node", "n", "bits", "cells"])


def _apart_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with the better of the two lower bounds on their symmetric difference."""
    for batch in it:
        apart = [x if a is None or b is None else max(x, _cells_apart(a, b))
                 for x, a, b in zip(*(batch.column(c).to_pylist() for c in ("apart", "cells_a", "cells_b")))]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("a", "b", "total")), pa.array(apart, pa.int64())], ["a", "b", "total", "apart"])


def _set_pass(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def recurring() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            count = np.diff(np.append(first, len(values)))
            many = count > 1
            hashes, count = values[first[many]].view(np.int64), count[many]
            nothing = pa.nulls(len(hashes), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(hashes), id_type), nothing, nothing, nothing, pa.nulls(len(hashes), pa.list_(pa.int64())),
                 pa.nulls(len(hashes), pa.binary()), pa.array(hashes), pa.array(count)],
                ["doc_id", "h", "n", "node", "bits", "cells", "shingle", "seen"])

        for batch in it:
            id_type = batch.column("doc_id").type
            n, node, bits, cells = [], [], [], []
            for s in tokens.shingle_sets(_texts(batch), k):
                n.append(len(s))
                node.append(_node(s))
                bits.append(_bitmap(s))
                cells.append(_cells(s))
                held.append(s)
                size += len(s)
                if size >= FLUSH:
                    yield recurring()
                    held, size = [], 0
            rows = len(n)
            flat = pa.array(np.concatenate(bits)) if rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BITMAP_WORDS, pa.int32()), flat),
                 pa.array(cells, pa.binary()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())],
                ["doc_id", "h", "n", "node", "bits", "cells", "shingle", "seen"])
        if held:
            yield recurring()
    return run


def prefix_length(n, percent: int):
    """How many leading shingles of a set must hold one that a linked set shares."""
    return n - (n * percent + 99) // 100 + 1


def _ordered_prefix(shingles: np.ndarray, percent: int, frequent: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The leading shingles in the global order (frequency level, hash)."""
    p = prefix_length(len(shingles), percent)
    if len(frequent):
        at = np.searchsorted(frequent, shingles)
        at[at == len(frequent)] = 0
        rank = np.where(frequent[at] == shingles, level[at], 0)
        if rank.any():
            return shingles[np.argsort(rank, kind="stable")[:p]]
    return shingles[:p]


def _chain_pass(k: int, percent: int, order):
    """Rows (token, a, n, b, hot): a holder of a shingle or, when ``b`` is set, a chain link.

    A shingle held ``CROWD`` times by what a task has read is chained there;
    only its first holder goes on, marked ``hot``.
    """
    def flush(tok: list, own: list, sizes: list) -> pa.RecordBatch:
        t, o, n = np.concatenate(tok), np.concatenate(own), np.concatenate(sizes)
        at = np.lexsort((tokens.mix(o.view(np.uint64) ^ t), n, t))
        t, o, n = t[at].view(np.int64), o[at], n[at]
        first = np.concatenate(([True], t[1:] != t[:-1]))
        run = np.cumsum(first) - 1
        hot = np.bincount(run)[run] >= CROWD
        link = hot & ~first
        before = np.concatenate((o[:1], o[:-1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(t), pa.array(o), pa.array(n), pa.array(before, mask=~link), pa.array(hot)], ["token", "a", "n", "b", "hot"])

    def run(it):
        frequent, level = order.value
        seen: set[int] = set()
        tok, own, sizes, size = [], [], [], 0
        for batch in it:
            for s in tokens.shingle_sets(_texts(batch), k):
                if not len(s) or (node := _node(s)) in seen:
                    continue
                seen.add(node)
                p = _ordered_prefix(s, percent, frequent, level)
                tok.append(p)
                own.append(np.full(len(p), node, np.int64))
                sizes.append(np.full(len(p), len(s), np.int32))
                size += len(p)
                if size >= FLUSH:
                    yield flush(tok, own, sizes)
                    tok, own, sizes, size = [], [], [], 0
        if tok:
            yield flush(tok, own, sizes)
    return run


def _filter_of(spark: SparkSession, values: DataFrame):
    """A broadcast bitmap over a column ``v`` of hashes: no false negatives.

    Its size is fixed, whatever the number of values.
    """
    slot = F.pmod("v", F.lit(FILTER_BITS)).alias("s")
    words = (values.select(slot).groupBy(F.expr("cast(s div 64 as int)").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("m"))).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words["w"].to_numpy()] = words["m"].to_numpy()
    return spark.sparkContext.broadcast(bitmap)


def _passes(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values & (FILTER_BITS - 1)
    return (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1


def _segment_pass(k: int, members):
    """Rows (node, fragment, shingles) of the sets whose node passes the filter."""
    edges = (np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS))

    def run(it):
        bitmap = members.value
        seen: set[int] = set()
        for batch in it:
            node, frag, lists = [], [], []
            for s in tokens.shingle_sets(_texts(batch), k):
                own = _node(s)
                if not len(s) or own in seen or not _passes(bitmap, np.array([own]))[0]:
                    continue
                seen.add(own)
                for f, part in enumerate(np.split(s, np.searchsorted(s, edges))):
                    if len(part):
                        node.append(own)
                        frag.append(f)
                        lists.append(part.view(np.int64))
            if node:
                ends = np.cumsum([0] + [len(x) for x in lists])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(frag, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))],
                    ["node", "fragment", "shingles"])
    return run


def _rest_pass(k: int, percent: int, order, members):
    """Rows (token, node) for the prefix shingles that pass the membership filter."""
    def run(it):
        frequent, level = order.value
        bitmap = members.value
        seen: set[int] = set()
        for batch in it:
            toks, nodes = [], []
            for s in tokens.shingle_sets(_texts(batch), k):
                if not len(s) or (node := _node(s)) in seen:
                    continue
                seen.add(node)
                p = _ordered_prefix(s, percent, frequent, level).view(np.int64)
                p = p[_passes(bitmap, p)]
                toks.append(p)
                nodes.append(np.full(len(p), node, np.int64))
            if toks:
                t, o = np.concatenate(toks), np.concatenate(nodes)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(o)], ["token", "node"])
    return run


def _block_pass(percent: int):
    """Pairs of different components inside runs of equal (token, x, y), by size, bitmap and range counts.

    A pair found in many runs of a task is sent on once per ``FOUND`` pairs.
    """
    def pairs(cols: dict[str, np.ndarray]):
        n, comp, node, side = cols["n"], cols["comp"], cols["node"], cols["side"]
        order = np.argsort(n, kind="stable")
        n, comp, node, side, bits, cells = n[order], comp[order], node[order], side[order], cols["bits"][order], cols["cells"][order]
        ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def counts(few: int) -> tuple[np.ndarray, np.ndarray]:
            """The range counts of the rows that have so many, and each row's place there (or -1)."""
            if few not in ranges:
                has = [i for i, c in enumerate(cells) if c is not None and len(c) >= few]
                place = np.full(len(cells), -1)
                place[has] = np.arange(len(has))
                ranges[few] = np.array([_folded(cells[i], few) for i in has], np.int16), place
            return ranges[few]
        two = bool(side.any())
        top = np.searchsorted(n, n * 100 // percent, side="right")
        for i in range(len(n)):
            j = np.arange(i + 1, top[i])
            j = j[comp[j] != comp[i]]
            if two:
                j = j[side[j] != side[i]]
            if not len(j):
                continue
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1)
            total = n[i] + n[j]
            # |A ^ B| is at least the bitmaps' distance and at most what a link allows
            j = j[apart * (100 + percent) <= total * (100 - percent)]
            if len(j) and cells[i] is not None:
                held, place = counts(len(cells[i]))
                at = place[j]
                apart = np.where(at < 0, 0, np.abs(held[at] - held[place[i]]).sum(axis=1, dtype=np.int64))
                j = j[apart * (100 + percent) <= (n[i] + n[j]) * (100 - percent)]
            if len(j):
                yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j])

    def run(it):
        held: dict[str, np.ndarray] | None = None
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in it:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "x", "y", "side", "node", "comp", "n", "cells")}
            new["bits"] = batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, BITMAP_WORDS // 2)
            cols = new if held is None else {c: np.concatenate((held[c], new[c])) for c in new}
            key = np.stack((cols["token"], cols["x"], cols["y"]))
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            last = int(cut[-1]) if len(cut) else 0
            for a, b in zip(np.concatenate(([0], cut[:-1])) if len(cut) else [], cut):
                if b - a > 1:
                    for pair in pairs({c: v[a:b] for c, v in cols.items()}):
                        found.append(pair)
                        size += len(pair[0])
                        if size >= FOUND:
                            found = [distinct(found)]
                            size = len(found[0][0])
                            if size >= FOUND // 2:
                                yield out(*found[0])
                                found, size = [], 0
            held = {c: v[last:] for c, v in cols.items()}
        if held is not None and len(held["n"]) > 1:
            found += pairs(held)
        if found:
            yield out(*distinct(found))

    def distinct(found):
        ab = np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1)
        return ab[0], ab[1]

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    return run


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, staging: Staging):
        self.spark, self.k, self.percent, self.staging = docs.sparkSession, k, percent, staging
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        bounded_batches(self.spark)
        id_type = self.docs.schema["doc_id"].dataType.simpleString()
        both = self.docs.withColumn("h", F.xxhash64("text")).mapInArrow(
            _set_pass(k), f"doc_id {id_type}, h bigint, n bigint, node bigint, bits array<bigint>, cells binary, "
            "shingle bigint, seen bigint")
        both = staging.put(both, "sets")
        self.rows = both.where("shingle is null").select("doc_id", "h", "n", "node", "bits", "cells")
        self.order = self._frequent(both.where("shingle is not null"))
        # One row per node; copies pre-aggregate inside their tasks.
        self.nodes = staging.put(
            self.rows.where("n > 0").groupBy("node")
            .agg(F.min("doc_id").alias("doc_id"),
                 F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("first"), F.max("n").alias("n"), F.first("bits").alias("bits"),
                 F.first("cells").alias("cells")), "nodes")

    def _frequent(self, seen: DataFrame):
        """The most frequent recurring shingles with their level, at most ``FREQUENT``."""
        total = self.staging.put(seen.groupBy("shingle").agg(F.sum("seen").alias("c"))
                                 .select("shingle", F.floor(F.log2("c")).cast("int").alias("level")), "recurring")
        sizes = dict(total.groupBy("level").count().collect())  # a few dozen levels
        kept, lowest = 0, 64
        for level in sorted(sizes, reverse=True):
            if level < 3 or kept + sizes[level] > FREQUENT:
                break
            kept, lowest = kept + sizes[level], level
        top = total.where(F.col("level") >= lowest).toPandas()
        hashes = top["shingle"].to_numpy(np.int64).view(np.uint64)
        at = np.argsort(hashes)
        self.staging.drop(total)
        return self.spark.sparkContext.broadcast((hashes[at], top["level"].to_numpy(np.int8)[at]))

    def links(self, pairs: DataFrame, nearest: int | None = None) -> DataFrame:
        """The pairs (a, b) that link: sizes, bitmaps, range counts, then overlaps summed over fragments.

        ``nearest`` counts only each node's so many nearest partners by these bounds.
        """
        p = self.percent
        meta = self.nodes.select("node", "n", "bits")
        apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                            F.lit(0), lambda s, x: s + x)
        total = F.col("n_a") + F.col("n_b")
        # |A ^ B| is at least either bound and at most what a link allows
        near = F.col("apart") * (100 + p) <= F.col("total") * (100 - p)
        side = lambda s: meta.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"),
                                     F.col("bits").alias(f"bits_{s}"))
        open_pairs = (pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
                      .join(side("a"), "a").join(side("b"), "b")
                      .where(100 * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b"))
                      .select("a", "b", total.alias("total"), apart.cast("bigint").alias("apart")).where(near))
        cells = self.nodes.where("cells is not null")
        counts = lambda s: cells.select(F.col("node").alias(s), F.col("cells").alias(f"cells_{s}"))
        open_pairs = (open_pairs.join(counts("a"), "a", "left").join(counts("b"), "b", "left")
                      .mapInArrow(_apart_pass, "a bigint, b bigint, total bigint, apart bigint").where(near))
        if nearest is not None:
            rank = lambda x, y: F.row_number().over(Window.partitionBy(x).orderBy("apart", F.xxhash64(y)))
            open_pairs = open_pairs.withColumn("ra", rank("a", "b")).withColumn("rb", rank("b", "a")).where(
                (F.col("ra") <= nearest) | (F.col("rb") <= nearest))
        open_pairs = self.staging.put(open_pairs.select("a", "b", "total"), "pairs")
        wanted = open_pairs.select(F.col("a").alias("v")).unionAll(open_pairs.select(F.col("b").alias("v")))
        segments = self._segments(wanted)
        left = segments.select(F.col("node").alias("a"), "fragment", F.col("shingles").alias("left"))
        right = segments.select(F.col("node").alias("b"), "fragment", F.col("shingles").alias("right"))
        # a row per fragment, so that both joins read the one shuffle of the segments
        cut = open_pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
        partial = (cut.join(left, ["a", "fragment"]).join(right, ["b", "fragment"])
                   .select("a", "b", "total", F.size(F.array_intersect("left", "right")).alias("overlap")))
        out = (partial.groupBy("a", "b", "total").agg(F.sum("overlap").alias("overlap"))
               .where((100 + p) * F.col("overlap") >= p * F.col("total")).select("a", "b"))
        out = self.staging.put(out, "links")
        self.staging.drop(open_pairs)
        return out

    def _segments(self, wanted: DataFrame) -> DataFrame:
        """Fragments of the wanted nodes' sets, one row per node and fragment.

        The membership filter keeps the other sets out of the shuffle; the few
        that slip through join with no pair.
        """
        cut = self.docs.select("text").mapInArrow(
            _segment_pass(self.k, _filter_of(self.spark, wanted)), "node bigint, fragment int, shingles array<bigint>")
        # copies read by different tasks
        return cut.repartition("node", "fragment").dropDuplicates(["node", "fragment"])

    def solve(self) -> DataFrame:
        """(node, root) for the nodes that link with another one."""
        st = self.staging
        held = self.docs.select("text").mapInArrow(
            _chain_pass(self.k, self.percent, self.order), "token bigint, a bigint, n int, b bigint, hot boolean")
        # Links made inside a task are spread; the others of a shingle are chained by size.
        here = F.col("b").isNotNull()
        deal = F.when(here, F.pmod(F.xxhash64("a"), F.lit(9973))).otherwise(-1)
        w = Window.partitionBy("token", "deal").orderBy("n", F.xxhash64("a", "token"), "a")
        whole = Window.partitionBy("token", "deal")
        near = 100 * F.col("m") >= self.percent * F.col("n")
        chain = (held.withColumn("deal", deal).withColumn("before", F.lag("a").over(w)).withColumn("m", F.lag("n").over(w))
                 .withColumn("hot", F.max("hot").over(whole))
                 .select("token", "a", F.when(here, F.col("b")).otherwise(F.col("before")).alias("b"), "hot", (here | near).alias("near"))
                 .where("a <> b and (near or hot)"))
        chain = st.put(chain, "chain")
        first = self.links(chain.select("a", "b"), NEAREST)
        comp = components(first, st)
        side = lambda s: comp.select(F.col("node").alias(s), F.col("root").alias(f"r{s}"))
        apart = (chain.join(side("a"), "a", "left").join(side("b"), "b", "left")
                 .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("token").distinct())
        apart = st.put(apart, "apart")
        second = self._rest(apart, comp)
        rest = self.links(second)
        merged = rest.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
            F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        upper = components(merged, st).withColumnRenamed("root", "top").withColumnRenamed("node", "root")
        known = comp.unionAll(upper.join(comp.select("root").distinct(), "root", "left_anti")
                              .select(F.col("root").alias("node"), "root"))
        out = known.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        out = st.put(out.distinct(), "roots")
        st.drop(chain, first, apart, second, rest)
        return out

    def _rest(self, apart: DataFrame, comp: DataFrame) -> DataFrame:
        st = self.staging
        members = _filter_of(self.spark, apart.select(F.col("token").alias("v")))
        post = self.docs.select("text").mapInArrow(_rest_pass(self.k, self.percent, self.order, members), "token bigint, node bigint")
        post = st.put(post.join(apart, "token", "left_semi").distinct(), "holders")
        # a shared passage has many shingles with the same holders: one of them gives the same pairs
        held = post.groupBy("token").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
                                         F.count("*").alias("c"))
        told = held.where("c > 1").groupBy("x", "y", "c").agg(F.min("token").alias("token")).select("token")
        whole, post = post, post.join(told, "token", "left_semi")
        # half as many bits, by folding, do for the blocks
        half = BITMAP_WORDS // 2
        folded = F.zip_with(F.slice("bits", 1, half), F.slice("bits", half + 1, half), lambda x, y: x.bitwiseXOR(y))
        known = self.nodes.select("node", "n", folded.alias("bits"), "cells").mapInArrow(
            _coarse_pass, "node bigint, n bigint, bits array<bigint>, cells binary")
        post = (post.join(known, "node")
                .join(comp, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"))
        post = st.put(post, "rest")
        st.drop(whole)
        blocks = st.put(post.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m")).where("m > 1"), "blocks")
        own = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
        # every block meets itself and each other block once
        dealt = (post.join(blocks, "token", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("own", own)
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
                 .select("token", F.least("own", "other").cast("int").alias("x"), F.greatest("own", "other").cast("int").alias("y"),
                         F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
                         "node", "comp", "n", "bits", "cells"))
        dealt = dealt.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
        found = st.put(dealt.mapInArrow(_block_pass(self.percent), "a bigint, b bigint").distinct(), "block-pairs")
        st.drop(post, blocks)
        return found


def _members(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, h, n_shingles, component_id, keeper``: text hash, and that of the component's least row."""
    staging = Staging(docs.sparkSession, "ngram-join")
    join = _Join(docs, k, percent, id_col, text_col, staging)
    roots = join.solve()
    least = (join.nodes.select("node", "first").join(roots, "node")
             .groupBy("root").agg(F.min("first").alias("least")))
    named = staging.put(join.nodes.select("node", "first").join(roots, "node", "left").join(least, "root", "left")
                        .select("node", F.coalesce("least", "first").alias("least")), "named")
    return (join.rows.select("doc_id", "h", "n", "node").join(named, "node", "left")
            .select("doc_id", "h", F.col("n").alias("n_shingles"),
                    F.coalesce("least.doc_id", "doc_id").alias("component_id"), F.col("least.h").alias("keeper")))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``."""
    return _members(docs, k, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the least id (and text hash).

    Rows without words all stay.  Repeated rows (equal id and text) leave one.
    Rows without an id can't be named by a decision: they stay.
    """
    staging = Staging(docs.sparkSession, "keep-one")
    found = staging.put(_members(docs, k, percent, id_col, text_col).where("n_shingles > 0 and doc_id is not null"), "found")
    keeper = (F.col("doc_id") == F.col("component_id")) & (F.col("h") == F.col("keeper"))
    key = [F.col("doc_id").alias(id_col), F.col("h").alias("__h")]
    gone = found.where(~keeper).select(*key).distinct()
    rows = docs.withColumn("__h", F.xxhash64(text_col))
    kept = rows.join(gone, [id_col, "__h"], "left_anti")
    twice = staging.put(found.where(keeper).groupBy("doc_id", "h").count().where("count > 1").select(*key), "twice")
    if twice.limit(1).count():
        again = kept.join(twice, [id_col, "__h"], "left_semi").dropDuplicates([id_col, "__h"])
        kept = kept.join(twice, [id_col, "__h"], "left_anti").unionByName(again)
    return kept.select(*docs.columns)
