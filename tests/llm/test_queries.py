"""Registration, SQL oracles and the pipeline over a small input."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tillroll.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    expected = sorted((tuple(r) for r in found.fetchall()), key=str)
    assert sorted((tuple(r[n] for n in names) for r in QUERIES[name](spark, SF).collect()), key=str) == expected


def test_pipeline_keeps_its_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "pii", "mixing", "sentencepiece"]
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in out}
    assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()} and len(ids) > 100
    assert max(sum(1 for r in out if r["doc_id"] == i) for i in list(ids)[:50]) <= 2
    assert all(len(r["ids"]) == r["n_ids"] for r in out)
