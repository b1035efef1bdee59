"""What the operators leave behind: no setting of the session, no file once the driver has ended."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from tidewire.llm import queries
from tidewire.llm.common import BATCH_BYTES, BATCH_ROWS, sliced


def settings_of(spark):
    return {r.key: r.value for r in spark.sql("SET").collect()}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_changes_no_setting(spark, sf, name):
    before = settings_of(spark)
    queries.QUERIES[name](spark, sf).limit(1).collect()
    assert settings_of(spark) == before


def test_stages_change_no_setting(spark, sf):
    before, docs = settings_of(spark), spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).limit(1).collect()
        assert settings_of(spark) == before


SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
import __spark_entry__
queries = __spark_entry__.queries()
for name in sys.argv[3:]:
    queries[name](spark, sys.argv[2]).count()
"""


def test_no_file_is_left(tmp_path, sf):
    names = ["op2_toxicity", "op5_packing", "op6_ann", "op8_url_filters", "op12_whitening", "st_window", "snk_item"]
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), sf, *names], capture_output=True, text=True, timeout=600, cwd=os.path.dirname(corpus_pipeline.__file__))
    assert run.returncode == 0, run.stderr[-2000:]
    assert [f for _, _, files in os.walk(tmp_path) for f in files] == []


def test_slices_are_bounded_by_rows_and_bytes():
    import pyarrow as pa

    texts = ["a" * (i % 7) * 300_000 for i in range(60)] + ["b"] * 1700 + ["c" * 3 * BATCH_BYTES, None, ""]
    parts = list(sliced([pa.RecordBatch.from_pydict({"t": pa.array(texts)})]))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows <= BATCH_ROWS and (p.nbytes <= BATCH_BYTES or p.num_rows == 1) for p in parts)
    empty = pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})
    assert [p.num_rows for p in sliced([empty])] == [0]
