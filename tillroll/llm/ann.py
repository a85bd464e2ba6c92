"""Approximate nearest neighbours by cosine: stable projections, kd-trees, a chi-square stop.

Vectors are brought to unit length and projected by a fixed Gaussian matrix to
``DIMS`` dimensions.  For two unit vectors at distance d the squared distance of
their projections, over d squared, follows a chi-square law with ``DIMS`` degrees
of freedom.  So a search walks projected neighbours from near to far, verifies
each on the original vectors, and stops when a vector nearer than the k-th best
so far would lie that far away with a chance below ``MISS``.

* **Index.** The top of the kd-tree is fitted on at most ``SAMPLE`` rows (least
  hash of the id) and cuts the projected space into at most ``SAMPLE // 16`` cells;
  every row is put into its cell.  A cell over ``CELL_ROWS`` rows is dealt into
  parts by a hash of the id, so a block (cell, part) stays bounded however the
  vectors crowd.  Each block is one stored row with its own kd-tree.
* **Search.** Blocks of queries meet index blocks in two rounds: the home cell of
  each query first, which bounds its k-th distance; then every other cell whose
  box the stopping radius reaches.  Both rounds are the same join and walk.
* **Copies.** Of equal vectors only the ``k + 1`` smallest ids can be among the k
  nearest of any query (one may be the query), so no others are indexed; every row
  may still ask.

Defined results: vectors that are null, empty, all zero or hold a null or
non-finite component take no part, nor do null ids; a shorter vector counts as
padded with zeros; a repeated row counts once; an id with several vectors is a
candidate by each and asks with the least of them; a query's own id is never its
neighbour; ties go to the smaller id; with fewer than k candidates all are
returned; an empty table gives no rows.  Columns other than the id and the vector
are ignored under any name.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from tillroll.llm.common import Staging

DIMS = 8
MISS = 0.02
SAMPLE = 1 << 14
CELL_ROWS = 1 << 13
LEAF_ROWS = 64
QUERY_BLOCK = 1 << 10
# Rows that a batch hands to Python: index blocks are a few MB each.
BLOCKS_A_BATCH = 4
VECTORS_A_BATCH = 4096


def stopping_factor(miss: float = MISS, dims: int = DIMS) -> float:
    """The squared radius, in squared k-th distances, beyond which a nearer vector is missed by ``miss`` at most.

    Upper quantile of the chi-square law; for an even number of degrees its tail is a finite sum.
    """
    def tail(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return total

    low, high = 0.0, 1e3
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > miss else (low, mid)
    return high


def _matrix(width: int) -> np.ndarray:
    return np.random.default_rng(20250117).standard_normal((width, DIMS))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish (cosines stay the same)."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """An array column as a matrix, shorter rows filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _valid(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


class _Top:
    """The top of the kd-tree: an implicit binary tree of splits, whose leaves are the cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.depth = cells.bit_length() - 1
        self.dim = np.zeros(max(cells - 1, 1), np.int64)
        self.cut = np.zeros(max(cells - 1, 1))
        parts = {0: sample}
        for node in range(cells - 1):
            rows = parts.pop(node)
            d = int(np.ptp(rows, axis=0).argmax()) if len(rows) else 0
            cut = float(np.median(rows[:, d])) if len(rows) else 0.0
            self.dim[node], self.cut[node] = d, cut
            left = rows[:, d] <= cut if len(rows) else np.zeros(0, bool)
            parts[2 * node + 1], parts[2 * node + 2] = rows[left], rows[~left]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.dim[node]] > self.cut[node])
        return node - (2 ** self.depth - 1)


def _project(width: int, top: _Top | None, dtype: str):
    """Adds the projection, and the cell once the top of the tree is known."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = _matrix(width)
        for batch in batches:
            vectors = _padded(batch.column("vec"), width)
            unit = _scaled(vectors)
            unit /= _norms(unit)[:, None]
            points = unit @ matrix
            pack = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            cells = top.cell(points) if top else np.zeros(len(points), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, pa.int32()), batch.column("id").cast(pa.int64()), pack(points), pack(vectors.astype(dtype))],
                names=["cell", "id", "point", "vec"])

    return run


_PROJECTED = "cell int, id bigint, point binary, vec binary"


def _stack(rows: list[bytes], dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def _kd_order(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row order and leaf edges of a balanced kd-tree; leaf i holds rows edges[i]:edges[i + 1]."""
    order = np.arange(len(points))
    edges = [0, len(points)]
    while max(np.diff(edges)) > LEAF_ROWS:
        cut = [0]
        for a, b in zip(edges, edges[1:]):
            mid = (a + b) // 2
            if b - a > 1:
                rows = points[order[a:b]]
                by = rows[:, int(np.ptp(rows, axis=0).argmax())]
                order[a:b] = order[a:b][np.argpartition(by, mid - a)]
            cut += [mid, b]
        edges = cut
    return order, np.array(edges)


_INDEX = pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("n", pa.int32()),
                    ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
                    ("ids", pa.binary()), ("points", pa.binary()), ("vecs", pa.binary()), ("edges", pa.binary())])


def _index_blocks(dtype: str):
    """One row per block: rows come sorted by (cell, part)."""
    def block(key: tuple[int, int], rows: list[dict]) -> pa.RecordBatch:
        points = _stack([r["point"] for r in rows], "<f8")
        order, edges = _kd_order(points)
        vectors = _stack([r["vec"] for r in rows], dtype)
        ids = np.array([r["id"] for r in rows], np.int64)
        return pa.RecordBatch.from_pylist([{
            "cell": key[0], "part": key[1], "n": len(rows), "low": points.min(axis=0).tolist(), "high": points.max(axis=0).tolist(),
            "ids": ids[order].tobytes(), "points": points[order].tobytes(), "vecs": vectors[order].tobytes(),
            "edges": edges.astype(np.int64).tobytes()}], _INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["cell"], row["part"]) != key:
                    if rows:
                        yield block(key, rows)
                    key, rows = (row["cell"], row["part"]), []
                rows.append(row)
        if rows:
            yield block(key, rows)

    return run


_QUERIES = pa.schema([("cell", pa.int32()), ("ids", pa.binary()), ("points", pa.binary()), ("vecs", pa.binary()), ("bounds", pa.binary())])


def _query_blocks(boxes: tuple[np.ndarray, np.ndarray, np.ndarray] | None, dtype: str):
    """Queries packed by the cell that they visit.

    Without boxes that is the home cell; with them every other cell that the
    stopping radius around the query reaches.  ``bound`` is the squared distance of
    the k-th neighbour so far, infinite if there are fewer.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = stopping_factor()
        waiting: list[dict] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            home = np.array([r["cell"] for r in waiting])
            ids = np.array([r["id"] for r in waiting], np.int64)
            points, vectors = _stack([r["point"] for r in waiting], "<f8"), _stack([r["vec"] for r in waiting], dtype)
            bounds = np.array([r["bound"] for r in waiting])
            if boxes is None:
                visits = [(c, home == c) for c in np.unique(home).tolist()]
            else:
                visits = []
                for cell, low, high in zip(*boxes):
                    gap = np.maximum(np.maximum(low - points, points - high), 0)
                    visits.append((int(cell), (home != cell) & ((gap * gap).sum(axis=1) <= factor * bounds + 1e-9)))
            for cell, who in visits:
                if who.any():
                    yield pa.RecordBatch.from_pylist([{
                        "cell": cell, "ids": ids[who].tobytes(), "points": points[who].tobytes(), "vecs": vectors[who].tobytes(),
                        "bounds": bounds[who].tobytes()}], _QUERIES)

        for batch in batches:
            for row in batch.to_pylist():
                waiting.append(row)
                if len(waiting) == QUERY_BLOCK:
                    yield from blocks()
                    waiting = []
        if waiting:
            yield from blocks()

    return run


def _walk(tree, point, vector, own, bound, k, factor):
    """One query in one block: ``(score, id)`` of the k best found, and no more work than the test asks for."""
    ids, points, vectors, norms, edges, low, high, leaves = tree
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    gap = (gap * gap).sum(axis=1)
    norm = math.sqrt(float((vector * vector).sum()))
    best: list[tuple[float, int]] = []  # a heap: the worst of the k first, as (score, -id)
    queue = [(gap[0], 0)]
    while queue:
        near, node = heapq.heappop(queue)
        if near > factor * bound + 1e-9:
            break
        if node < leaves - 1:
            for child in (2 * node + 1, 2 * node + 2):
                heapq.heappush(queue, (gap[child], child))
            continue
        a, b = edges[node - leaves + 1], edges[node - leaves + 2]
        away = points[a:b] - point
        rows = a + np.flatnonzero((away * away).sum(axis=1) <= factor * bound + 1e-9)
        if not len(rows):
            continue
        scores = (vectors[rows] * vector).sum(axis=1) / (norms[rows] * norm)
        for score, name in zip(scores.tolist(), ids[rows].tolist()):
            if name == own:
                continue
            if len(best) < k:
                heapq.heappush(best, (score, -name))
            elif (score, -name) > best[0]:
                heapq.heapreplace(best, (score, -name))
        if len(best) == k:
            bound = min(bound, max(0.0, 2 - 2 * best[0][0]))
    return best


def _probe(k: int, dtype: str):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def load(row: dict):
        ids, edges = np.frombuffer(row["i_ids"], np.int64), np.frombuffer(row["i_edges"], np.int64)
        points = np.frombuffer(row["i_points"], "<f8").reshape(len(ids), -1)
        vectors = _scaled(np.frombuffer(row["i_vecs"], dtype).reshape(len(ids), -1).astype(np.float64))
        leaves = len(edges) - 1
        low = np.full((2 * leaves - 1, points.shape[1]), np.inf)
        high = -low
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                low[leaves - 1 + i], high[leaves - 1 + i] = points[a:b].min(axis=0), points[a:b].max(axis=0)
        for i in range(leaves - 2, -1, -1):
            low[i], high[i] = np.minimum(low[2 * i + 1], low[2 * i + 2]), np.maximum(high[2 * i + 1], high[2 * i + 2])
        return ids, points, vectors, _norms(vectors), edges, low, high, leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = stopping_factor()
        name = tree = None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["cell"], row["part"]) != name:
                    name, tree = (row["cell"], row["part"]), load(row)
                own = np.frombuffer(row["ids"], np.int64)
                points = np.frombuffer(row["points"], "<f8").reshape(len(own), -1)
                vectors = _scaled(np.frombuffer(row["vecs"], dtype).reshape(len(own), -1).astype(np.float64))
                bounds = np.frombuffer(row["bounds"], "<f8")
                asked, found, scores = [], [], []
                for i, q in enumerate(own.tolist()):
                    for score, negative in _walk(tree, points[i], vectors[i], q, float(bounds[i]), k, factor):
                        asked.append(q)
                        found.append(-negative)
                        scores.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())],
                                                 schema=schema)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # an id with several vectors may be found by more than one of them
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, asks: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of each row for which ``asks`` holds: ``query_id, rank, vec_id, score``."""
    spark = vectors.sparkSession
    staging = Staging(spark, "ann")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting, None)
    kind = vectors.schema[vector_column].dataType.elementType
    dtype = "<f4" if isinstance(kind, FloatType) else "<f8"
    vec = F.col(vector_column) if dtype == "<f4" else F.col(vector_column).cast("array<double>")
    base = vectors.select(F.col(id_column).cast("bigint").alias("id"), vec.alias("vec"), F.coalesce(asks, F.lit(False)).alias("asks"))
    base = base.where(F.col("id").isNotNull() & _valid(F.col("vec"))).groupBy("vec", "id").agg(F.max("asks").alias("asks"))
    base = staging.put(base, "vectors")
    try:
        spark.conf.set(setting, str(VECTORS_A_BATCH))
        width = base.select(F.max(F.size("vec"))).first()[0] or 1
        copies = Window.partitionBy("vec").orderBy("id")
        kept = base.select("id", "vec").withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
        kept = staging.put(kept, "distinct")
        total = kept.count()
        sample = (kept.mapInArrow(_project(width, None, dtype), _PROJECTED).select("point", "id")
                  .orderBy(F.xxhash64("id"), "id", "point").limit(SAMPLE).collect())
        points = _stack([bytes(r["point"]) for r in sample], "<f8") if sample else np.zeros((0, DIMS))
        cells = 1 << min(max(0, -(-total // CELL_ROWS) - 1).bit_length(), max(0, (len(sample) // 16).bit_length() - 1))
        top = _Top(points, cells)
        placed = staging.put(kept.mapInArrow(_project(width, top, dtype), _PROJECTED), "cells")
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))  # at most SAMPLE // 16 rows
        dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        index = staging.put(dealt.drop("parts").repartition("cell", "part").sortWithinPartitions("cell", "part", "id")
                            .mapInArrow(_index_blocks(dtype), "cell int, part int, n int, low array<double>, high array<double>, ids binary, "
                                                              "points binary, vecs binary, edges binary"), "index")
        staging.drop(placed, kept)
        queries = base.where("asks").groupBy("id").agg(F.min("vec").alias("vec"))
        queries = staging.put(queries.mapInArrow(_project(width, top, dtype), _PROJECTED), "queries")
        spark.conf.set(setting, str(BLOCKS_A_BATCH))
        first = _round(staging, index, queries.withColumn("bound", F.lit(float("inf"))), None, k, dtype, "home")
        reached = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        bound = F.when(F.col("n") >= k, F.greatest(F.lit(0.0), 2 - 2 * F.col("kth"))).otherwise(F.lit(float("inf")))
        asked = queries.join(reached.withColumnRenamed("query_id", "id"), "id", "left").withColumn("bound", bound).drop("kth", "n")
        second = _round(staging, index, asked, _cell_boxes(index), k, dtype, "others")
        return _best(first.unionByName(second), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def _cell_boxes(index: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells and the two corners of each cell's box: at most SAMPLE // 16 rows."""
    corners = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(DIMS)]
    rows = np.array([list(r) for r in index.groupBy("cell").agg(*corners).collect()]).reshape(-1, 1 + 2 * DIMS)
    return rows[:, 0].astype(np.int64), rows[:, 1:1 + DIMS], rows[:, 1 + DIMS:]


def _round(staging: Staging, index: DataFrame, queries: DataFrame, boxes, k: int, dtype: str, name: str) -> DataFrame:
    """Query blocks against the index blocks of the cells that they visit."""
    spark = index.sparkSession
    blocks = staging.put(queries.select("cell", "id", "point", "vec", "bound").mapInArrow(
        _query_blocks(boxes, dtype), "cell int, ids binary, points binary, vecs binary, bounds binary"), f"{name}-queries")
    stored = index.select("cell", "part", *[F.col(c).alias(f"i_{c}") for c in ("ids", "points", "vecs", "edges")])
    met = stored.join(blocks, "cell").mapInArrow(_probe(k, dtype), "query_id bigint, vec_id bigint, score double")
    found = staging.put(_best(met, k).drop("rank"), name)
    staging.drop(blocks)
    return found
