"""Phrase collocations by partitioned mining (the SON scheme).

The corpus is cut into a fixed number of shards by a hash of the row.  Every
shard is mined completely at a support lowered to its share of the words; a
phrase that is frequent in the whole corpus is locally frequent in at least one
shard, so the union of the locally frequent phrases misses none.  One more scan
counts that union exactly over all texts.

* **A shard is no task.**  It grows with the corpus (its local support does
  not), and any number of tasks mine it together: each sends sorted hash arrays
  with counts, cut by hash range; the task of a range adds them up.  Phrases of
  a third of all rows are added up in every task before anything is sent.
* **Mining a shard** goes by length: words, pairs of frequent words, then three
  to five words whose inner pairs are all frequent.
* **The union** is a Bloom filter of fixed size (``FILTER_BITS``), put together from
  the slices of the hash ranges: a chance hit costs a count, never a result.  The last scan sums the phrases themselves, not hashes,
  per language and phrase; inside one run of a task 64-bit hashes stand for them.

Defined results: a null text is empty, a null language is ``und``, a repeated row
counts again, an empty table gives no rows, texts are read whole, columns other
than ``text`` and ``lang`` are ignored under any name.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.common import Staging, bounded_batches
from tillroll.llm.tokens import mix, words

SHARDS = 8
LONGEST = 5
FILTER_BITS = 26
# Bits that a phrase sets, all in the slice of its hash range.
PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
# Phrase occurrences that a task holds before it adds them up and sends them.
RUN = 1 << 22
# Text bytes per hash range; a range's distinct phrases must fit a task.
RANGE_BYTES = 1 << 23
LEAST_RANGES = 64
# Texts handled at a time.
CHUNK_BYTES = 1 << 20

_CUTS = np.zeros(256, bool)
_CUTS[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True  # . , ; : ! ? and line ends
_BREAKS = _CUTS.copy()
_BREAKS[[0x20, 0x09]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class _Chunk:
    """Words of some texts of one language, with the piece that each belongs to."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join(texts)
        self.hash, self.start, self.end = words(self.buffer, lower=True, breaks=_BREAKS)
        data = np.frombuffer(self.buffer, np.uint8)
        self.piece = np.searchsorted(np.flatnonzero(_CUTS[data]), self.start)

    def starts(self, k: int) -> np.ndarray:
        """Words that start a phrase of ``k`` words inside one piece."""
        n = len(self.hash) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1:]) if n > 0 else np.zeros(0, np.int64)

    def keys(self, at: np.ndarray, k: int, lang: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.blake2b(f"{k}:{lang}".encode(), digest_size=8).digest(), "little")
        total = np.full(len(at), seed, np.uint64)
        weight = k
        for j in range(k):
            weight = weight * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03 & (1 << 64) - 1
            total += self.hash[at + j] * np.uint64(weight | 1)
        return mix(total)

    def phrase(self, at: int, k: int) -> str:
        return " ".join(self.buffer[self.start[i]:self.end[i]].translate(_LOWER).decode("utf-8") for i in range(at, at + k))


class _Filter:
    """A Bloom filter in slices: a key's leading bits pick its slice, the probes the bits in it."""

    def __init__(self, bits: bytes, ranges: int):
        self.bits, self.low = np.frombuffer(bits, np.uint8), ranges.bit_length() - 1

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        for probe in PROBES:
            at = _place(keys[left], self.low, probe)
            left = left[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        found[left] = True
        return found


def _place(keys: np.ndarray, low: int, probe: int) -> np.ndarray:
    inside = np.uint64(FILTER_BITS - low)
    return ((keys >> np.uint64(64 - low)) << inside) | ((keys * np.uint64(probe)) >> (np.uint64(64) - inside))


def _inner(at: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Those of ``at`` whose ``width`` consecutive parts are all marked in ``ok``."""
    keep = ok[at]
    for j in range(1, width):
        keep = keep & ok[at + j]
    return at[keep]


def _marks(chunk: _Chunk, lang: str, k: int, known: _Filter, at: np.ndarray | None = None) -> np.ndarray:
    """A mark per word: does a phrase of ``k`` words that passes the filter start here?"""
    at = chunk.starts(k) if at is None else at
    ok = np.zeros(len(chunk.hash) + LONGEST, bool)
    ok[at[known.has(chunk.keys(at, k, lang))]] = True
    return ok


def _level(chunk: _Chunk, lang: str, level: int, filters: list[_Filter]) -> np.ndarray:
    """Keys of the phrases that level counts: words, pairs, or three and more words."""
    if level == 1:
        return chunk.keys(np.arange(len(chunk.hash)), 1, lang)
    once = _marks(chunk, lang, 1, filters[0])
    pairs = _inner(chunk.starts(2), once, 2)
    if level == 2:
        return chunk.keys(pairs, 2, lang)
    twice = _marks(chunk, lang, 2, filters[1], pairs)
    return np.concatenate([chunk.keys(_inner(chunk.starts(k), twice, k - 1), k, lang) for k in range(3, LONGEST + 1)])


def _grouped(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, list[bytes]]]:
    """Texts of a batch by group, in chunks of about ``CHUNK_BYTES``."""
    groups: dict[tuple, list[bytes]] = {}
    sizes: dict[tuple, int] = {}
    texts = batch.column("text")
    for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in by))):
        raw = texts[i].as_buffer()
        raw = raw.to_pybytes() if raw is not None else b""
        groups.setdefault(key, []).append(raw)
        sizes[key] = sizes.get(key, 0) + len(raw)
        if sizes[key] > CHUNK_BYTES:
            yield key, groups.pop(key)
            sizes.pop(key)
    yield from groups.items()


def _summed(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    joined = np.concatenate(keys)
    if counts is None:
        return np.unique(joined, return_counts=True)
    order = np.argsort(joined, kind="stable")
    joined, add = joined[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate(([True], joined[1:] != joined[:-1])))
    return joined[first], np.add.reduceat(add, first)


_PARTS = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("shard", pa.int32()), ("n", pa.int64()),
                    ("keys", pa.binary()), ("counts", pa.binary())])


def _parts(level: int, filters, ranges: int):
    """Map side of a level: per hash range, language and shard, sorted keys with their counts.

    Level 1 also sends the number of words, as a row of range -1.
    """
    bits = ranges.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [_Filter(f.value, ranges) for f in filters]
        held: dict[tuple, list[np.ndarray]] = {}
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, shard), lists in held.items():
                keys, counts = _summed(lists)
                if level == 1:
                    yield pa.RecordBatch.from_pylist(
                        [{"range": -1, "lang": lang, "shard": shard, "n": int(counts.sum())}], _PARTS)
                if not len(keys):
                    continue
                cuts = np.searchsorted(keys, np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - bits))
                edges = [0, *cuts.tolist(), len(keys)]
                full = [i for i in range(ranges) if edges[i] < edges[i + 1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int32()), pa.array([lang] * len(full), pa.string()),
                    pa.array([shard] * len(full), pa.int32()), pa.array([None] * len(full), pa.int64()),
                    pa.array([keys[edges[i]:edges[i + 1]].tobytes() for i in full], pa.binary()),
                    pa.array([counts[edges[i]:edges[i + 1]].astype(np.uint32).tobytes() for i in full], pa.binary())],
                    schema=_PARTS)

        for batch in batches:
            for (lang, shard), texts in _grouped(batch, ["lang", "shard"]):
                keys = _level(_Chunk(texts), lang, level, maps)
                held.setdefault((lang, shard), []).append(keys)
                n_held += len(keys)
                if n_held >= RUN:
                    yield from flush()
                    held, n_held = {}, 0
        yield from flush()

    return run


def _frequent(ranges: int):
    """Reduce side: the slice of the filter that a hash range owns.

    Rows come sorted by range, language and shard, with the shard's support.
    """
    slice_bytes = (1 << FILTER_BITS) // ranges // 8
    schema = pa.schema([("range", pa.int32()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = current = None
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        waiting = merged = support = 0
        out = np.zeros(0, np.uint8)

        def close() -> None:
            nonlocal keys, counts, waiting, merged
            if keys:
                k, c = _summed(keys, counts)
                for probe in PROBES:
                    at = _place(k[c >= support], ranges.bit_length() - 1, probe).astype(np.int64) - current * slice_bytes * 8
                    np.bitwise_or.at(out, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            keys, counts, waiting, merged = [], [], 0, 0

        for batch in batches:
            for row in batch.to_pylist():
                if (row["range"], row["lang"], row["shard"]) != group:
                    close()
                    if row["range"] != current:
                        if current is not None:
                            yield pa.RecordBatch.from_pylist([{"range": current, "bits": out.tobytes()}], schema)
                        current, out = row["range"], np.zeros(slice_bytes, np.uint8)
                    group, support = (row["range"], row["lang"], row["shard"]), row["support"]
                keys.append(np.frombuffer(row["keys"], np.uint64))
                counts.append(np.frombuffer(row["counts"], np.uint32).astype(np.int64))
                waiting += len(keys[-1])
                if waiting > max(RUN, merged):
                    k, c = _summed(keys, counts)
                    keys, counts, waiting, merged = [k], [c], 0, len(k)
        close()
        if current is not None:
            yield pa.RecordBatch.from_pylist([{"range": current, "bits": out.tobytes()}], schema)

    return run


def _phrases(filters, ranges: int):
    """Last scan, map side: phrases that pass the filters with their occurrences, packed per language and hash range."""
    low = ranges.bit_length() - 1
    schema = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("phrases", pa.string()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [_Filter(f.value, ranges) for f in filters]
        names: dict[str, dict[int, str]] = {}
        sums: dict[str, dict[int, int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in sums.items():
                packed: dict[int, list[int]] = {}
                for key in found:
                    packed.setdefault(key >> 64 - low, []).append(key)
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(packed), pa.int32()), pa.array([lang] * len(packed), pa.string()),
                    pa.array(["\n".join(names[lang][k] for k in keys) for keys in packed.values()], pa.string()),
                    pa.array([np.array([found[k] for k in keys], np.int64).tobytes() for keys in packed.values()], pa.binary())],
                    schema=schema)

        for batch in batches:
            for (lang,), texts in _grouped(batch, ["lang"]):
                chunk = _Chunk(texts)
                name, total = names.setdefault(lang, {}), sums.setdefault(lang, {})
                ok, at = None, np.arange(len(chunk.hash))
                for k in range(1, LONGEST + 1):
                    if k > 1:
                        at = _inner(chunk.starts(k), ok, 2)
                    keys = chunk.keys(at, k, lang)
                    hit = maps[min(k, 3) - 1].has(keys)
                    at, keys = at[hit], keys[hit]
                    ok = np.zeros(len(chunk.hash) + LONGEST, bool)
                    ok[at] = True
                    found, first, counts = np.unique(keys, return_index=True, return_counts=True)
                    for key, i, c in zip(found.tolist(), first.tolist(), counts.tolist()):
                        if key in total:
                            total[key] += c
                        else:
                            name[key], total[key] = chunk.phrase(int(at[i]), k), c
                if sum(map(len, sums.values())) >= RUN // 8:
                    yield from flush()
                    names.clear()
                    sums.clear()
        yield from flush()

    return run


def _added_up(support: int):
    """Last scan, reduce side: rows come sorted by hash range and language; phrases themselves are added up, not hashes."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sums = None, Counter()

        def close() -> pa.RecordBatch:
            kept = [(p, f) for p, f in sums.items() if f >= support]
            return pa.RecordBatch.from_arrays([
                pa.array([group[1]] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.string()),
                pa.array([p.count(" ") + 1 for p, _ in kept], pa.int32()), pa.array([f for _, f in kept], pa.int64())], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["range"], row["lang"]) != group:
                    if group is not None:
                        yield close()
                    group, sums = (row["range"], row["lang"]), Counter()
                for phrase, count in zip(row["phrases"].split("\n"), np.frombuffer(row["counts"], np.int64).tolist()):
                    sums[phrase] += count
        if group is not None:
            yield close()

    return run


def phrase_counts(docs: DataFrame, support: int, staging: Staging, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, size, f)`` of all phrases of one to five words with ``f >= support``; ``(lang, n)``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    key = [F.col(c) for c in ("doc_id", "text") if c in docs.columns]
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int").alias("shard"),
                        F.encode("text", "UTF-8").alias("text"))
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(LEAST_RANGES, -(-size // RANGE_BYTES)).bit_length() - 1
    filters: list = []
    for level in (1, 2, 3):
        parts = texts.mapInArrow(_parts(level, filters, ranges), "range int, lang string, shard int, n bigint, keys binary, counts binary")
        if level == 1:
            parts = staging.put(parts, "words")
            shares = staging.put(parts.where("range = -1").groupBy("lang", "shard").agg(F.sum("n").alias("n")), "shares")
            total = shares.groupBy("lang").agg(F.sum("n").alias("n"))
            wide = lambda c: F.col(c).cast("decimal(19,0)")
            local = shares.join(total.withColumnRenamed("n", "of"), "lang").where("of > 0").select(
                "lang", "shard", F.ceil(wide("n") * F.lit(support) / wide("of")).cast("bigint").alias("support"))
        frequent = (parts.where("range >= 0").drop("n").join(local, ["lang", "shard"])
                    .repartition(ranges, "range").sortWithinPartitions("range", "lang", "shard")
                    .select("range", "lang", "shard", "support", "keys", "counts")
                    .mapInArrow(_frequent(ranges), "range int, bits binary"))
        step = (1 << FILTER_BITS) // ranges // 8
        bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
        for row in frequent.collect():  # together the filter, whose size is fixed
            bits[row["range"] * step:(row["range"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
        filters.append(spark.sparkContext.broadcast(bits.tobytes()))
        if level == 1:
            staging.drop(parts)
    counted = (texts.select("lang", "text").mapInArrow(_phrases(filters, ranges), "range int, lang string, phrases string, counts binary")
               .repartition(ranges, "range").sortWithinPartitions("range", "lang")
               .mapInArrow(_added_up(support), "lang string, phrase string, size int, f bigint"))
    return staging.put(counted, "phrases"), total


def collocations(docs: DataFrame, support: int = 100, top: int = 2000, inside_percent: int = 100, shards: int = SHARDS) -> DataFrame:
    """The ``top`` phrases of two to five words per language: ``lang, rank, phrase, a, l, r, n, score``.

    The score of a phrase is that of its weakest cut into two parts, the number of
    its occurrences over what independent parts would give, in thousandths.  A
    phrase that lies inside a longer one with ``inside_percent`` of its count goes.
    """
    staging = Staging(docs.sparkSession, "collocation")
    counted, total = phrase_counts(docs, support, staging, shards)
    long = counted.where("size >= 2").withColumn("w", F.split("phrase", " "))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    side = counted.select("lang", "phrase", "f")
    cuts = (long.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"),
                    part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
            .join(side.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(side.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
            .join(total, "lang"))
    dec = lambda c: F.col(c).cast("decimal(19,0)")
    scored = (cuts.withColumn("up", (dec("a") * dec("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"))
              .withColumn("down", dec("l") * dec("r")).withColumn("score", F.expr("up div down"))
              .groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best")))
    inner = (long.where("size >= 3").select("lang", "w", "f", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
             .select("lang", "w", "f", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("at"))
             .groupBy("lang", part(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("f").alias("longer")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.select("lang", "phrase", "best.*").join(inner, ["lang", "phrase"], "left")
            .where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(inside_percent) * F.col("a"), F.lit(True)))
            .withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
