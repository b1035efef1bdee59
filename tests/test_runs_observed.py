"""Counts that a run makes while it writes, against the aggregates, and in one job."""

import time

from pyspark.sql import functions as F

from tidewire.operators import dedup, runs

FORM = "id long, source string, drop_reason string"


def made(n):
    return [(i, f"s{i % 3}", [None, "cutoff", "scope", "raw_dedup", "hash_dedup", "unresolved", None][i % 7]) for i in range(n)]


def test_counts_of_a_write(spark, tmp_path):
    items = spark.createDataFrame(made(500), FORM)
    tracker, group = spark.sparkContext.statusTracker(), "counted write"
    rows, counts = runs.counted(items)
    spark.sparkContext.setJobGroup(group, group)
    rows.write.parquet(str(tmp_path / "out"))
    got = counts.get
    spark.sparkContext.setJobGroup("", "")
    assert len(tracker.getJobIdsForGroup(group)) == 1
    total = dedup.run_funnel(items).drop("source", "duplicate")
    want = total.agg(*(F.sum(c).alias(c) for c in total.columns)).first().asDict()
    assert got == want and got["found"] == 500 == spark.read.parquet(str(tmp_path / "out")).count()


def test_a_row_for_each_batch_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame(made(100 + k), FORM).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    counts = runs.BatchCounts()
    spark.streams.addListener(counts)
    try:
        stream = spark.readStream.schema(FORM).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = runs.counted_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.monotonic() + 20
        while len(counts.rows) < 3 and time.monotonic() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counts)
    rows = counts.table(spark).orderBy("batch").collect()
    assert [r.found for r in rows] == [100, 101, 102] and [r.batch for r in rows] == [0, 1, 2]
    assert sum(r.new for r in rows) == sum(x[2] is None for k in range(3) for x in made(100 + k))
