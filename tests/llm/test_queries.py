"""Every registered query of the package and the pipeline on the driver's small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from eventloom.llm import queries  # noqa: E402
from eventloom.llm.text import write_read  # noqa: E402
from eventloom.plans import check  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Queries that do not return a row per document.
ROWS = {"op4_neighbours", "op7_mixing", "op10_chat", "op11_negatives", "op12_urlrules", "op13_spelling"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    con = check.connect(SF)
    ok, message, _ = check.compare(spark, con, SF, name, queries.QUERIES[name], queries.ORACLES.get(name))
    assert ok, message
    if name not in ROWS:
        assert message.split()[0] == str(con.execute("SELECT count(*) FROM documents").fetchone()[0])


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = write_read(stage(spark, seen, SF), f"{folder}/{k}")
        if name == "token_shards":
            assert out.count() == seen.count() and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        else:
            assert out.columns == docs.columns
            if name == "mixing":
                assert {r.doc_id for r in out.collect()} == {r.doc_id for r in seen.collect()}
            else:
                assert out.count() <= seen.count()
        seen = out


def test_pipeline_of_odd_and_empty_tables(spark, folder):
    rows = [(1, None, None, None, None, "x"), (None, "a b c", None, None, None, "x"), (2, "", "en", "s", 0, None), (3, "w " * 50_000, "en", "s", 5, "y"), (3, "w " * 50_000, "en", "s", 5, "y")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hits string")
    for docs in (odd, odd.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = write_read(stage(spark, docs, SF), f"{folder}/{docs.count()}-{k}")
            if name != "token_shards":
                assert out.columns == odd.columns
            docs = out
        assert docs.count() in (0, 3, 4, 5)
