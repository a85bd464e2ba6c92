"""Quality rules: a word n-gram perplexity with per-language bands, and text counts.

The language model is an interpolated modified Kneser-Ney model over pairs of
words, one per language, counted by Spark over every document.  A word is a run
without white space; characters of scripts that do not set words apart (Chinese,
Japanese, Thai, ...) are words of their own; all are known by 64-bit hashes.

The model lies in the cells of a grid: a pair belongs to the row of its
context's hash and the column of its word's hash, so that a context or a word
that holds a third of all pairs is spread over a whole row or column.  A cell
keeps sorted hash arrays (contexts, words, pairs) and an array of counts; the
grid grows with the corpus.  Runs of texts are counted in their tasks first and
sent as one compressed row per run and cell.  What all cells of a row know of a
context, or those of a column of a word, is summed and sent back to each cell in
the order of its own hashes.  The rows of the grid are taken in a few rounds that
read the texts anew, so that only a part of all pairs lies on disk.  For scoring, each run sends the
pairs of its distinct texts to the same cells, where they are found by binary
search; a cell answers with one sum per text.  Sums are whole numbers (units of
2^-32 bits), so no order of tasks changes them.  As every document is counted,
every pair has an entry.  A document's log2 perplexity is the mean of ``-log2
p`` over its words, the first one following the start of the text.

A document is kept when its base rules hold and its log2 perplexity lies in
its language's band: the median plus and minus ``LOWER`` / ``UPPER`` times the
median absolute deviation over that language's documents that pass the base
rules (at least ``LEAST_DEVIATION``), widened for short texts, whose perplexity
scatters, by ``sqrt(1 + SLACK_WORDS / n_words)``.  Repetitive texts fall below the band,
shouting, tables, shuffled words and symbol noise above.

Null, empty and white-only texts have zero counts and a null perplexity, and
fail the base rules.  A null language is a language of its own.  Repeated rows
and equal ids are scored row by row; other columns are ignored.  An empty table
gives an empty result.  A text longer than a run is a run of its own, held in
one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import tokens
from tillroll.llm.common import Staging, bounded_batches

FLUSH = 1 << 21            # words of a run
CELL_BYTES = 32 << 20      # text that a cell of the grid takes on average
LEAST_GRID = 4
COUNT_ROUNDS, SCORE_ROUNDS = 2, 3      # parts of the grid's rows taken one after another
UNITS = float(1 << 32)
LOWER, UPPER = 5.0, 5.0
LEAST_DEVIATION = 0.01
SLACK_WORDS = 100
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_ALONE = np.zeros(256, bool)
_ALONE[0xE3:0xF5] = True  # kana, Chinese, Hangul, symbols beyond the base plane


@cache
def _lang_hash(lang: str | None) -> int:
    raw = np.frombuffer(b"\0" if lang is None else b"\1" + lang.encode(), np.uint8).astype(np.uint64)
    weights = np.arange(1, len(raw) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(tokens.mix(np.array([(tokens.mix(raw + weights)).sum(dtype=np.uint64)], np.uint64))[0])


def _spaced(raw: bytes) -> bytes:
    """The text with spaces around the characters of scripts that do not set words apart."""
    if raw.isascii():
        return raw
    data = np.frombuffer(raw, np.uint8)
    if data.max() < 0xE0:
        return raw
    second = np.append(data[1:], np.uint8(0))
    alone = _ALONE[data] | ((data == 0xE0) & (second >= 0xB8) & (second <= 0xBB)) | (
        (data == 0xE1) & ((second <= 0x82) | (second == 0x9E) | (second == 0x9F)))
    if not alone.any():
        return raw
    first = (data & 0xC0) != 0x80
    # a space before each such character and before the character behind it
    at = np.flatnonzero(first)
    cut = np.union1d(at[alone[at]], at[1:][alone[at[:-1]]])
    return np.insert(data, cut, np.uint8(32)).tobytes()


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes of the least width."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    body = np.ascontiguousarray(planes).tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    body = pa.decompress(raw[9:], decompressed_size=width * n, codec="zstd", asbytes=True) if n else b""
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _packed_rising(values: np.ndarray) -> bytes:
    return _packed(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def _unpacked_rising(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw), dtype=np.uint64)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_PARTS = pa.schema([("cell", pa.int32()), ("lang", pa.string()), ("kind", pa.int32()), ("batch", pa.int64()),
                    *((c, pa.binary()) for c in ("context", "word", "x", "y", "z", "k"))])
_PARTS_DDL = ("cell int, lang string, kind int, batch bigint, context binary, word binary, x binary, y binary, z binary, k binary")
DISCOUNTS, CONTEXTS, WORDS, MODEL, TEXTS, NAMES = range(-1, 5)     # kinds of rows, in the order a cell reads them


def _gathered(it: Iterator[pa.RecordBatch], take, flush: int):
    """Runs of words: texts of one language, each distinct text once with its number of copies."""
    held: dict[str | None, dict[tuple[int, int], list]] = {}
    fresh: list[tuple[list, bytes, int]] = []
    waiting = size = 0

    def hashed() -> int:
        """Fills in the words of the fresh texts, all of them hashed as one."""
        _, hashes, _, _, cuts = tokens.joined([raw for _, raw, _ in fresh])
        words = tokens.mix(hashes + np.repeat(np.array([code for *_, code in fresh], np.uint64), np.diff(cuts)))
        for (entry, *_), a, b in zip(fresh, cuts[:-1].tolist(), cuts[1:].tolist()):
            entry[0] = words[a:b]
        fresh.clear()
        return len(words)

    for batch in it:
        rows = zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(),
                   batch.column("h1").to_pylist(), batch.column("h2").to_pylist())
        for lang, raw, h1, h2 in rows:
            own = held.setdefault(lang, {})
            if (h1, h2) in own:
                own[h1, h2][1] += 1
                continue
            own[h1, h2] = [None, 1]
            raw = _spaced(raw or b"")
            fresh.append((own[h1, h2], raw, _lang_hash(lang)))
            waiting += len(raw)
            if waiting >= min(flush, tokens.SEGMENT_BYTES):
                size += hashed()
                waiting = 0
            if size >= flush:
                for x, texts in held.items():
                    yield from take(x, texts)
                held, size = {}, 0
    if fresh:
        hashed()
    for x, texts in held.items():
        yield from take(x, texts)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the place of each value among them."""
    coded = pa.array(values).dictionary_encode()
    known = coded.dictionary.to_numpy()
    order = np.argsort(known)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return known[order], place[coded.indices.to_numpy()]


def _counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs, or the sum of its weights."""
    if weights is None:
        return np.unique(values, return_counts=True)
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.add.reduceat(weights[order].astype(np.int64), first)


def _cut_pass(grid: int, scoring: bool, part: int = 0, rounds: int = 1):
    """Pairs of words dealt to the cells of the grid (context's hash, word's hash), of one round's rows.

    For counting a row holds a run's distinct pairs of a cell and their counts,
    for scoring the pairs of each text of the run.
    """
    flush = FLUSH

    def run(it):

        here = TaskContext.get().partitionId() << 32
        number = [0]

        def take(lang, texts):
            texts = {key: v for key, v in texts.items() if len(v[0])}
            if not texts:
                return
            code = np.uint64(_lang_hash(lang))
            lengths = np.array([len(v[0]) for v in texts.values()])
            word, starts = np.concatenate([v[0] for v in texts.values()]), np.cumsum(lengths) - lengths
            column = (word % np.uint64(grid)).astype(np.int64)
            context, row = np.roll(word, 1), np.roll(column, 1)
            context[starts], row[starts] = code, int(code) % grid
            doc = np.repeat(np.arange(len(texts)), lengths)
            weight = np.repeat(np.array([v[1] for v in texts.values()]), lengths)
            copied = weight.max() > 1
            cell = row * grid + column
            mine = np.flatnonzero(row % rounds == part)
            order = mine[np.argsort(cell[mine].astype(np.uint16) if grid <= 256 else cell[mine], kind="stable")]
            ends = np.flatnonzero(np.diff(cell[order], append=-1)) + 1
            batch = here + number[0]
            number[0] += 1
            for a, b in zip(np.concatenate(([0], ends[:-1])), ends):
                own = order[a:b]
                contexts, c = _distinct(context[own])
                words, w = _distinct(word[own])
                pair = c * len(words) + w
                x = y = z = None
                if scoring:
                    span = len(contexts) * len(words)
                    keys, k = np.unique(doc[own] * span + pair, return_counts=True)
                    pair = keys % span
                    x, y, z = _packed_rising(keys // span), _packed(pair // len(words)), _packed(pair % len(words))
                else:
                    keys, k = _counted(pair, weight[own] if copied else None)
                    x = _packed_rising(keys)
                yield _rows([(int(cell[own[0]]), lang, TEXTS, batch, _packed_rising(contexts), _packed_rising(words),
                              x, y, z, _packed(k))], _PARTS)
            if scoring:
                names = np.array(list(texts), np.int64).view(np.uint64)
                yield _rows([(batch % (grid * grid), lang, NAMES, batch, None, None, _packed(names[:, 0]), _packed(names[:, 1]),
                              None, _packed(lengths))], _PARTS)
        yield from _gathered(it, take, flush)
    return run


def _grouped(it: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows of equal ``names``, read one by one."""
    def rows():
        for batch in it:
            for i in range(batch.num_rows):
                yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}
    yield from groupby(rows(), key=lambda r: tuple(r[n] for n in names))


def _merged(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct hashes of all parts, and each part's places among them."""
    known = np.unique(np.concatenate(parts))
    return known, [np.searchsorted(known, p) for p in parts]


def _how_many(values: np.ndarray) -> list[int]:
    return [int((values == i).sum()) for i in (1, 2, 3, 4)]


_COUNTS = ["n1", "n2", "n3", "n4", "total", "n_keys"]
_MODEL = pa.schema([*_PARTS, *((c, pa.int64()) for c in _COUNTS)])
_MODEL_DDL = _PARTS_DDL + "".join(f", {c} bigint" for c in _COUNTS)


def _count_pass(grid: int):
    """A cell's sorted pairs with their counts, and what it knows of its contexts and words."""
    def run(it):
        for (cell, lang), rows in _grouped(it, ["cell", "lang"]):
            rows = list(rows)
            contexts, c_at = _merged([_unpacked_rising(r["context"]) for r in rows])
            words, w_at = _merged([_unpacked_rising(r["word"]) for r in rows])
            pairs = []
            for r, c, w in zip(rows, c_at, w_at):
                pair = _unpacked_rising(r["x"]).astype(np.int64)
                pairs.append(c[pair // len(w)] * len(words) + w[pair % len(w)])
            keys, count = _counted(np.concatenate(pairs), np.concatenate([_unpacked(r["k"]) for r in rows]))
            c, w = keys // len(words), keys % len(words)
            of = lambda kept: np.bincount(c[kept], minlength=len(contexts))
            yield _rows([
                (cell // grid, lang, CONTEXTS, cell, _packed_rising(contexts), None, _packed(of(count == 1)), _packed(of(count == 2)),
                 _packed(of(count > 2)), _packed(np.bincount(c, weights=count)), *[None] * 6),
                (cell % grid, lang, WORDS, cell, None, _packed_rising(words), _packed(np.bincount(w)), None, None, None, *[None] * 6),
                (cell, lang, MODEL, 0, _packed_rising(contexts), _packed_rising(words), _packed_rising(keys), None, None,
                 _packed(count), *_how_many(count), int(count.sum()), len(keys))], _MODEL)
    return run


def _sum_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells' numbers per context or word, summed: one row back to each cell, in the order of its
    hashes, and one without arrays per kind, slot and language."""
    for (kind, slot, lang), rows in _grouped(it, ["kind", "cell", "lang"]):
        rows = list(rows)
        name, columns = ("context", "xyzk") if kind == CONTEXTS else ("word", "x")
        known, at = _merged([_unpacked_rising(r[name]) for r in rows])
        sums = {}
        for col in columns:
            sums[col] = np.zeros(len(known), np.int64)
            for r, a in zip(rows, at):
                sums[col][a] += _unpacked(r[col]).astype(np.int64)
        for r, a in zip(rows, at):
            yield _rows([(r["batch"], lang, kind, 0, None, None, *(_packed(sums[c][a]) if c in sums else None for c in "xyzk"),
                          *[None] * 6)], _MODEL)
        yield _rows([(slot, lang, kind, 0, *[None] * 6, *_how_many(sums["x"]), int(sums["x"].sum()), len(known))], _MODEL)


def _discounts(rows: DataFrame, prefix: str) -> DataFrame:
    """Per language the three discounts and the sums they need."""
    n = rows.groupBy("lang").agg(*(F.sum(c).cast("double").alias(c) for c in _COUNTS))
    return n.selectExpr(
        f"lang {prefix}lang", f"total {prefix}total", f"n_keys {prefix}keys", f"n1 {prefix}n1", f"n2 {prefix}n2",
        f"least(greatest(coalesce(1 - 2 * try_divide(n1, n1 + 2 * n2) * try_divide(n2, n1), 0.5D), 0.1D), 1D) {prefix}d1",
        f"least(greatest(coalesce(2 - 3 * try_divide(n1, n1 + 2 * n2) * try_divide(n3, n2), 1D), 0.1D), 2D) {prefix}d2",
        f"least(greatest(coalesce(3 - 4 * try_divide(n1, n1 + 2 * n2) * try_divide(n4, n3), 1.5D), 0.1D), 3D) {prefix}d3")


def _by_cell(parts: DataFrame, cells: int, *keys: str) -> DataFrame:
    return parts.repartition(cells, *keys).sortWithinPartitions(*keys)


def grid_of(docs: DataFrame) -> int:
    """Cells a side, so that a cell takes about ``CELL_BYTES`` of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_GRID, math.ceil(math.sqrt(size / CELL_BYTES)))


def word_model(docs: DataFrame, staging: Staging, grid: int | None = None) -> DataFrame:
    """The model of ``docs (lang, text, h1, h2)`` as sorted hash arrays.

    A ``MODEL`` row holds a cell's pairs in order with their counts (``n_keys``
    of them), ``CONTEXTS`` and ``WORDS`` rows what the discounts need: per cell
    in the order of its hashes, or as a slot's numbers without arrays.
    """
    grid = grid or grid_of(docs)
    model = sides = None
    for part in range(COUNT_ROUNDS):
        cut = docs.select("lang", "text", "h1", "h2").mapInArrow(_cut_pass(grid, False, part, COUNT_ROUNDS), _PARTS_DDL)
        counted = staging.put(_by_cell(cut, grid * grid, "cell", "lang").mapInArrow(_count_pass(grid), _MODEL_DDL), "counted")
        found, own = counted.where(F.col("kind") == MODEL), counted.where(F.col("kind") != MODEL)
        model, sides = (found, own) if model is None else (model.unionAll(found), sides.unionAll(own))
    sides = _by_cell(sides, 2 * grid, "kind", "cell", "lang").mapInArrow(_sum_pass, _MODEL_DDL)
    return model.unionAll(staging.put(sides, "sides"))


_SUMS = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("k", pa.binary())])
_SUMS_DDL = "batch bigint, kind int, x binary, y binary, k binary"
_DISCOUNT_COLS = [*(f"{p}{c}" for p in ("p_", "w_") for c in ("d1", "d2", "d3")), "w_total", "w_keys", "w_n1", "w_n2"]


def _discounted(count: np.ndarray, rates: dict, prefix: str) -> np.ndarray:
    return np.maximum(count - np.choose(np.clip(count, 1, 3) - 1, [rates[f"{prefix}d{i}"] for i in (1, 2, 3)]), 0.0)


def _look_up_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``-log2 p`` per text and cell, in units of 2^-32: the pairs of the texts are
    found in the cell's sorted arrays by binary search."""
    for _, rows in _grouped(it, ["cell", "lang"]):
        side: dict[int, tuple] = {}
        for r in rows:
            if r["kind"] == DISCOUNTS:
                rates = r
            elif r["kind"] == NAMES:
                yield _rows([(r["batch"], NAMES, r["x"], r["y"], r["k"])], _SUMS)
            elif r["kind"] == CONTEXTS:
                n1, n2, n3, total = (_unpacked(r[c]).astype(np.float64) for c in "xyzk")
                left = (rates["p_d1"] * n1 + rates["p_d2"] * n2 + rates["p_d3"] * n3) / total
                side[CONTEXTS] = total, left
            elif r["kind"] == WORDS:
                # how many words a word follows, interpolated with an even share of the words and one unseen
                n1, n2, n_words = rates["w_n1"], rates["w_n2"], rates["w_keys"]
                lent = rates["w_d1"] * n1 + rates["w_d2"] * n2 + rates["w_d3"] * (n_words - n1 - n2)
                own = _discounted(_unpacked(r["x"]).astype(np.int64), rates, "w_")
                side[WORDS] = (own + lent / (n_words + 1)) / rates["w_total"]
            elif r["kind"] == MODEL:
                contexts, words = _unpacked_rising(r["context"]), _unpacked_rising(r["word"])
                keys, count = _unpacked_rising(r["x"]).astype(np.int64), _unpacked(r["k"]).astype(np.int64)
                (total, left), low = side[CONTEXTS], side[WORDS]
                c, w = keys // len(words), keys % len(words)
                p = _discounted(count, rates, "p_") / total[c] + left[c] * low[w]
                value = np.rint(-np.log2(p) * UNITS).astype(np.int64)
            else:
                c, w = np.searchsorted(contexts, _unpacked_rising(r["context"])), np.searchsorted(words, _unpacked_rising(r["word"]))
                pair = c[_unpacked(r["y"]).astype(np.int64)] * len(words) + w[_unpacked(r["z"]).astype(np.int64)]
                said = value[np.searchsorted(keys, pair)] * _unpacked(r["k"]).astype(np.int64)
                doc = _unpacked_rising(r["x"])
                first = np.flatnonzero(np.diff(doc, prepend=doc[:1] + np.uint64(1)))
                yield _rows([(r["batch"], TEXTS, _packed_rising(doc[first]), _packed(np.add.reduceat(said, first)), None)], _SUMS)


def _mean_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the cells' sums up, run by run; the run's names come last."""
    for _, rows in _grouped(it, ["batch"]):
        parts = []
        for r in rows:
            if r["kind"] == TEXTS:
                parts.append((_unpacked_rising(r["x"]).astype(np.int64), _unpacked(r["y"]).astype(np.int64)))
                continue
            n = _unpacked(r["k"]).astype(np.int64)
            total = np.zeros(len(n), np.int64)
            for at, said in parts:
                total[at] += said
            yield pa.RecordBatch.from_arrays(
                [pa.array(_unpacked(r["x"]).view(np.int64)), pa.array(_unpacked(r["y"]).view(np.int64)), pa.array(total), pa.array(n)],
                ["h1", "h2", "said", "n"])


def perplexities(docs: DataFrame, model: DataFrame, grid: int, staging: Staging | None = None) -> DataFrame:
    """``(h1, h2, log2_perplexity)`` of each distinct text of ``docs (lang, text, h1, h2)`` that has words.

    Rows of equal text and language share their key: a mean does not change with copies.
    """
    staging = staging or Staging(docs.sparkSession, "perplexities")
    pairs, words = (_discounts(model.where(F.col("kind") == kind), p) for kind, p in ((MODEL, "p_"), (WORDS, "w_")))
    # a few numbers per language and cell travel as rows of their own, so no array meets a join
    rates = (pairs.join(words, F.col("p_lang").eqNullSafe(F.col("w_lang"))).withColumnRenamed("p_lang", "lang")
             .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1)))).withColumn("kind", F.lit(DISCOUNTS)))
    rates = staging.put(rates.select("cell", "lang", "kind", *_DISCOUNT_COLS), "rates")
    known = model.where("x is not null").select(*(f.name for f in _PARTS))
    said = None
    for part in range(SCORE_ROUNDS):
        mine = (F.floor(F.col("cell") / grid) % SCORE_ROUNDS) == part
        cut = docs.select("lang", "text", "h1", "h2").mapInArrow(_cut_pass(grid, True, part, SCORE_ROUNDS), _PARTS_DDL)
        both = known.where(mine).unionAll(cut).unionByName(rates.where(mine), allowMissingColumns=True)
        dealt = both.repartition(grid * grid, "cell", "lang").sortWithinPartitions("cell", "lang", "kind")
        sums = staging.put(dealt.mapInArrow(_look_up_pass, _SUMS_DDL), "sums")
        means = sums.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(
            _mean_pass, "h1 bigint, h2 bigint, said bigint, n bigint")
        # copies read by different tasks say the same
        own = staging.put(means.groupBy("h1", "h2").agg(F.max("said").alias("said"), F.max("n").alias("n")), "said")
        staging.drop(sums)
        said = own if said is None else said.unionAll(own)
    return said.groupBy("h1", "h2").agg((F.sum("said") / F.lit(UNITS) / F.max("n")).alias("log2_perplexity"))


def _repeated(grams: np.ndarray, n_words: int) -> int:
    """Words covered by windows that occur at least twice."""
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(grams, twice))
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _score_pass():
    def run(it):
        for batch in it:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows: list[tuple] = []
            for texts_run in tokens.batches(texts):
                buffer, hashes, starts, _, cuts = tokens.joined(texts_run)
                windows = tokens.windows(hashes, WINDOW)
                # one white byte more: the edge of an empty last text is the buffer's end
                data = np.frombuffer(buffer + b" ", np.uint8)
                inner = ((data & 0xC0) != 0x80) & (data != 32) & ~((data >= 9) & (data <= 13))
                edges = np.cumsum([0] + [len(r) + 1 for r in texts_run])[:-1]
                chars = np.add.reduceat(inner, edges, dtype=np.int64)
                symbols = np.add.reduceat(_SYMBOL[data], edges, dtype=np.int64)
                for i, raw in enumerate(texts_run):
                    a, b = int(cuts[i]), int(cuts[i + 1])
                    n = b - a
                    lines = [x for x in raw.split(b"\n") if x.strip()]
                    empty = not raw
                    rows.append((n, 0 if empty else int(chars[i]), 0 if empty else int(symbols[i]), len(lines) - len(set(lines)),
                                 _repeated(windows[a:b - WINDOW + 1], n) if n > WINDOW else 0))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "lang", "h1", "h2")), *(pa.array(c, pa.int64()) for c in cols)],
                ["doc_id", "lang", "h1", "h2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
    return run


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """One row per row of ``docs`` with its counts, log2 perplexity, band and verdict."""
    bounded_batches(docs.sparkSession)
    staging = Staging(docs.sparkSession, "quality")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    key = lambda i: F.xxhash64(F.lit(i), F.col("lang").isNull(), "lang", "text").alias(f"h{i}")
    docs = docs.select("*", key(1), key(2))
    grid = grid_of(docs)
    measured = staging.put(perplexities(docs, word_model(docs, staging, grid), grid, staging), "perplexities")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(
        _score_pass(), f"doc_id {id_type}, lang string, h1 bigint, h2 bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
        "n_dup_lines bigint, n_repeat_words bigint").join(measured, ["h1", "h2"], "left").drop("h1", "h2")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    scored = staging.put(scored.withColumn("base_failed", failed), "scored")
    fair = scored.where("not base_failed")
    middle = fair.groupBy(F.col("lang").alias("l2")).agg(F.percentile_approx("log2_perplexity", 0.5, 10000).alias("median"))
    middle = staging.put(middle, "median")
    spread = (fair.join(middle, F.col("lang").eqNullSafe(F.col("l2")))
              .groupBy("l2", "median")
              .agg(F.percentile_approx(F.abs(F.col("log2_perplexity") - F.col("median")), 0.5, 10000).alias("mad")))
    bands = staging.put(spread.select("l2", "median", F.greatest("mad", F.lit(LEAST_DEVIATION)).alias("width")), "bands")
    slack = F.col("width") * F.sqrt(1 + SLACK_WORDS / F.greatest("n_words", F.lit(1)))
    out = (scored.join(bands, F.col("lang").eqNullSafe(F.col("l2")), "left")
           .withColumn("band_low", F.when(F.col("n_words") > 0, F.col("median") - lower * slack))
           .withColumn("band_high", F.when(F.col("n_words") > 0, F.col("median") + upper * slack)))
    inside = F.col("log2_perplexity").between(F.col("band_low"), F.col("band_high"))
    return (out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
            .select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "log2_perplexity", "band_low", "band_high", "base_failed", "kept"))
