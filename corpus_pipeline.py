"""A corpus pipeline of five stages, each calling one operator of ``tillroll.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the result
is written as Parquet in the shared folder and reread as the next one's
``docs``.  All stages but the last return the columns of ``documents``:
``doc_id, text, lang, source, n_chars``.

1. ``toxicity``: documents whose learned score reaches 0.5 go.
2. ``near_duplicates``: one document stays of each group linked by a Jaccard
   similarity of 0.8 on five-word shingles.
3. ``pii``: entities are replaced by surrogates; ``n_chars`` follows the text.
4. ``mixing``: sources are weighted as evenly as a limit of two epochs allows; every document
   stays, and those of rarer sources come up to twice.
5. ``sentencepiece``: texts become piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import mixing, ngram_join, pieces, pii, toxicity
from tillroll.llm.common import Staging, table
from tillroll.llm.queries import MOST_EPOCHS, PIECE_MODEL, PII_KEY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels teach as in the query: a fifth of them is held out for judging."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return toxicity.drop_toxic(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, k=5, percent=80).select(*docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.replace(docs, PII_KEY).drop("n_entities")
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs, most_epochs=MOST_EPOCHS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.encode(docs, pieces.read_model(spark, PIECE_MODEL), keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_ids"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("pii", replace_pii),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

# The stages learn from the corpus or hash it in ways SQL does not have; tests/llm
# holds their operators, and the run's ids, columns and counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = Staging(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staging.put(stage(spark, docs, sf_dir), name)
    return docs
