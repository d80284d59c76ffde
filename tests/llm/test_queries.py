"""The registered queries beside their SQL, and the pipeline stage by stage."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from skyloom.llm.queries import ORACLES, QUERIES
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def test_all_are_registered():
    names = set(contract.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in names if q.startswith("op")}
    assert "pipeline" in names and set(QUERIES) <= names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result(spark, name):
    state, _, _, _, note = compare(spark, duck(SF), name, SF)
    assert state == "ok", note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_over_its_table(spark, name):
    rows = QUERIES[name](spark, SF).count()
    table = "pages" if name.startswith("op2_") else "documents"
    if name.split("_")[0] in ("op2", "op7", "op8"):
        assert rows == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows > 0


def test_pipeline_stages(spark):
    """Each stage keeps the columns; the result is that of the stages' operators in turn."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "pack"]
    left = [docs.count()]
    for name, fn in corpus_pipeline.STAGES:
        out = fn(spark, docs, SF)
        if name != "pack":
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
            left.append(docs.count())
    assert left == sorted(left, reverse=True) and left[-1] < left[0]
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_pipeline_of_odd_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, None), (2, None, "en", None, None)]
    rows += [(3, "the house of the rising sun is a song", "en", "s", 1), (3, "the house of the rising sun is a song", "en", "s", 1)]
    odd = spark.createDataFrame([(*r, 1, "x") for r in rows], schema.add("n_removed", "integer").add("row_key", "string"))
    for docs in (odd, odd.limit(0)):
        for name, fn in corpus_pipeline.STAGES:
            out = fn(spark, docs, SF)
            assert name == "pack" or out.columns == docs.columns
            out.collect()
