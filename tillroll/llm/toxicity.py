"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

*Folding.*  Lower case, compatibility forms resolved, zero-width
characters dropped, homoglyphs and digit or sign substitutions mapped to
letters, everything that is not a letter turned into
one space.  A lexicon entry starts at a word's start; it ends at the word's end
(a word) or inside it (a stem).

*Lexicon.*  Learned from labelled rows: log odds of a term's document
frequency in toxic against clean texts, less one standard error.  Fitting uses a bounded sample, at most
``SAMPLE`` rows of each label (those of least hash of the id, so the choice is
repeatable); all rows are scored.

*Score.*  Summed weights of the matches outside exception phrases, per square
root of the text's length in units of ``LENGTH_UNIT`` words, then a logistic
curve fitted on the sample.

Nulls, empty texts and texts without letters have no match and take the score
of a text without matches.  Rows with a null label or null id do not teach.
Repeated rows are scored row by row.  Without labelled rows of both kinds the
lexicon is empty and every score is 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import bounded_batches, free_name, Staging

SAMPLE = 20_000
STEMS = range(3, 10)
LEAST_TEXTS = 3
LEAST_SHARE = 0.015
LEAST_LOG_ODDS = 2.6
RIDGE = 1e-6
LENGTH_UNIT = 10_000

# Look-alike letters of other scripts, and digits that stand for
# letters; "1" may be "i" or "l", so these two are one letter.
HOMOGLYPHS = str.maketrans({
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "l": "i", "|": "i", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None, "­": None,
})
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = (
    "clown fish", "clown car", "class clown", "trash can", "trash bin", "trash bag", "pond scum",
    "scum line", "idiot proof", "sore loser", "take out the trash",
)

_SIGNS = {"!": "i", "@": "a", "$": "s", "€": "e"}
_INSIDE = re.compile(r"(?<=\w)[!@$€](?=\w)")
_NOT_LETTER = re.compile(r"(?:[^\w]|[\d_])+")


def fold(text: str | None) -> str:
    """Folded words, each preceded and the last followed by one space."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _INSIDE.sub(lambda m: _SIGNS[m.group()], text).translate(HOMOGLYPHS)
    return f" {_NOT_LETTER.sub(' ', text).strip()} "


def _terms(folded: str) -> set[str]:
    """A text's words and word stems, as lexicon entries: " word " or " stem"."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in STEMS if len(word) >= n)
    return out


def _term_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per term and label; each task adds up its own first."""
    count: dict[str, list[int]] = {}

    def flush():
        if count:
            toxic, clean = zip(*count.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(count), pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())],
                ["term", "toxic", "clean"])

    for batch in it:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            for term in _terms(fold(text)):
                count.setdefault(term, [0, 0])[0 if label else 1] += 1
            if len(count) > 1_000_000:
                yield from flush()
                count.clear()
    yield from flush()


def _automaton(lexicon: dict[str, float], exceptions: tuple[str, ...]):
    machine = ahocorasick.Automaton()
    for phrase in exceptions:
        machine.add_word(fold(phrase), (fold(phrase), None))
    for term, weight in lexicon.items():
        if not machine.exists(term):
            machine.add_word(term, (term, weight))
    if len(machine):
        machine.make_automaton()
    return machine


def matches(machine, folded: str) -> list[tuple[int, int, str, float]]:
    """Weighted matches ``(start, end, term, weight)``, one per word, outside exceptions."""
    if not len(machine):
        return []
    hits, excused = [], []
    for last, (term, weight) in machine.iter(folded):
        span = (last - len(term) + 1, last + 1)
        if weight is None:
            excused.append(span)
        else:
            hits.append((*span, term, weight))
    best: dict[int, tuple[int, int, str, float]] = {}
    for hit in hits:
        if any(a <= hit[0] and hit[1] <= b for a, b in excused):
            continue
        if hit[0] not in best or hit[3] > best[hit[0]][3]:
            best[hit[0]] = hit
    return list(best.values())


def density(machine, text: str | None) -> float:
    folded = fold(text)
    found = matches(machine, folded)
    if not found:
        return 0.0
    return sum(h[3] for h in found) / float(np.sqrt(1 + folded.count(" ") / LENGTH_UNIT))


def _lexicon(taught: DataFrame, staging: Staging) -> dict[str, float]:
    terms = taught.select("text", "label").mapInArrow(_term_pass, "term string, toxic bigint, clean bigint")
    # Equal texts teach once: they are grouped before, by their hash.
    sizes = taught.groupBy("label").count().collect()
    n = {bool(r["label"]): r["count"] for r in sizes}
    if not n.get(True) or not n.get(False):
        return {}
    least = max(LEAST_TEXTS, LEAST_SHARE * n[True])
    # less one standard error, so that a few chance texts do not make an entry
    odds = (F.log((F.col("toxic") + 0.5) / (n[True] + 1)) - F.log((F.col("clean") + 0.5) / (n[False] + 1))
            - F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5)))
    # At most (terms of a text / LEAST_SHARE) entries can pass: each is in that share of the toxic texts.
    found = (terms.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where(F.col("toxic") >= least).withColumn("weight", odds)
             .where(F.col("weight") >= LEAST_LOG_ODDS).select("term", "weight").collect())
    return {r["term"]: float(r["weight"]) for r in found}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a ridge-regularised logistic curve, classes weighted equally."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    scale = max(float(x.max(initial=0.0)), 1e-9)
    z, a, b = x / scale, 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        r = w * p * (1 - p)
        g = np.array([(w * (p - y) * z).sum() + RIDGE * a, (w * (p - y)).sum()])
        h = np.array([[(r * z * z).sum() + RIDGE, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return a / scale, b


class Model:
    """Lexicon, exceptions and curve; plain values, so that it travels in a broadcast."""

    def __init__(self, lexicon: dict[str, float], slope: float = 0.0, intercept: float = -1e3,
                 exceptions: tuple[str, ...] = EXCEPTIONS):
        self.lexicon, self.slope, self.intercept, self.exceptions = lexicon, slope, intercept, exceptions

    def machine(self):
        return _automaton(self.lexicon, self.exceptions)

    def score(self, d: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * d + self.intercept, -500, 500)))


def sample_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """At most ``SAMPLE`` labelled ids of each kind, those of least hash."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    order = [F.xxhash64("doc_id", F.lit("teach")), F.col("doc_id")]
    kinds = [known.where(F.col("label") == v).groupBy("doc_id", "label").count().drop("count").orderBy(*order).limit(SAMPLE)
             for v in (0, 1)]
    return kinds[0].unionAll(kinds[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)
    staging = Staging(spark, "toxicity")
    picked = staging.put(sample_labels(labels, id_col, label_col), "sample")
    # the sample has a fixed bound on its size: two columns, 2 * SAMPLE rows
    taught = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
              .join(F.broadcast(picked), "doc_id").where("text is not null"))
    taught = staging.put(taught.select("text", "label", F.xxhash64("text").alias("h"))
                         .dropDuplicates(["h", "label"]).select("text", "label"), "taught")
    model = Model(_lexicon(taught, staging), exceptions=exceptions)

    def run(it):
        machine = model.machine()
        for batch in it:
            d = [density(machine, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.float64()), batch.column("label")], ["d", "label"])

    if model.lexicon:
        points = taught.select("text", "label").mapInArrow(run, "d double, label int").toArrow()
        model.slope, model.intercept = _logistic(points["d"].to_numpy(), points["label"].to_numpy())
    staging.drop(picked, taught)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None,
          out: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and the score ``out`` of every whole text.

    A column of the documents with the name of the score gives way to it.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    extra = [] if text_col in names else [docs[text_col]]
    rows = docs.select(*[docs[c] for c in names], *extra)
    model_ref = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        machine, m = model_ref.value.machine(), model_ref.value
        for batch in it:
            d = np.array([density(machine, t) for t in batch.column(text_col).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(m.score(d))], [*names, out])

    schema = rows.select(*names).schema.add(out, "double")
    return rows.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; same columns."""
    model = train(docs, labels, id_col, text_col)
    out = free_name("score", docs.columns)
    return score(docs, model, text_col, out=out).where(F.col(out) < threshold).select(*docs.columns)
