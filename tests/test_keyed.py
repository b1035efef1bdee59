"""The keyed store: equal to insert_new, reads only the buckets it may hit, and a batch that comes again adds nothing."""

import glob
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewire.operators.keyed import KeyedStore
from tidewire.operators.store import insert_new

FORM = "article_hash string, pos long, text string"


def batches(seed, n=6, size=60, keys=180):
    rng = random.Random(seed)
    return [[(None if rng.random() < 0.02 else f"k{rng.randint(0, keys)}", b * 1000 + i, rng.choice(["", None, "x"])) for i in range(size)] for b in range(n)]


@pytest.mark.parametrize("words", [1, 64])
def test_equal_to_insert_new(spark, tmp_path, words):
    """With filters that are full, too: every key is then looked up."""
    kept = KeyedStore(spark, str(tmp_path / "store"), spark.createDataFrame([], FORM).schema, "article_hash", buckets=8, words=words)
    plain = spark.createDataFrame([], FORM)
    for rows in batches(1):
        batch = spark.createDataFrame(rows, FORM)
        new = insert_new(batch.where("article_hash is not null"), plain, ["pos"])
        want = {tuple(r) for r in new.select("article_hash", "pos", "text").collect()}
        assert {tuple(r) for r in kept.add(batch, ["pos"]).collect()} == want
        assert kept.add(batch, ["pos"]).count() == 0  # once more
        plain = spark.createDataFrame([*plain.collect(), *want], FORM)
    assert {tuple(r) for r in kept.rows.drop("bucket").collect()} == {tuple(r) for r in plain.collect()}
    kept.compact()
    assert {tuple(r) for r in kept.rows.drop("bucket").collect()} == {tuple(r) for r in plain.collect()}
    assert kept.add(plain, ["pos"]).count() == 0
    assert {tuple(r) for r in kept.held(plain.limit(5), ["pos"]).collect()} == {(r.article_hash, r.pos) for r in plain.limit(5).collect()}


def test_only_buckets_that_may_hold_a_key_are_read(spark, tmp_path):
    """The files of the others are made unreadable."""
    path = tmp_path / "store"
    kept = KeyedStore(spark, str(path), spark.createDataFrame([], FORM).schema, "article_hash", buckets=32, words=256)
    kept.add(spark.range(0, 2000).selectExpr("concat('k', id) article_hash", "id pos", "'t' text"), ["pos"])
    known = spark.createDataFrame([("k7", 1, None), ("k7", 2, None), ("k901", 3, None)], FORM)
    touched = {r.bucket for r in kept.suspects(known).collect()}
    assert len(touched) <= 2
    read = kept.rows.where(F.col("bucket").isin(*touched)).select(F.input_file_name().alias("f")).distinct().count()
    files = glob.glob(str(path / "bucket=*" / "*.parquet"))
    assert read <= 2 < len(files) and len(files) == 32
    for f in files:
        if not any(f"/bucket={b}/" in f for b in touched):
            Path(f).write_bytes(b"no table")
    assert kept.add(known, ["pos"]).count() == 0
    never = spark.range(0, 300).selectExpr("concat('n', id) article_hash", "id pos", "'t' text")
    passed = kept.suspects(never).count()
    assert passed <= 15  # new keys that look stored: two keys a word here
    clean = never.join(kept.suspects(never), "article_hash", "left_anti")
    assert kept.add(clean, ["pos"]).count() == 300 - passed


def test_bits_without_rows_cost_no_row(spark, tmp_path):
    """A batch that failed after its bits were written is taken in full when it comes again."""
    kept = KeyedStore(spark, str(tmp_path / "store"), spark.createDataFrame([], FORM).schema, "article_hash", buckets=4, words=64)
    batch = spark.range(0, 50).selectExpr("concat('k', id) article_hash", "id pos", "'t' text")
    placed = kept._with_place(batch)
    placed.selectExpr("_bucket bucket", "_word word", "_mask bits").write.mode("append").parquet(kept._filters)
    assert kept.suspects(batch).count() == 50
    assert kept.add(batch, ["pos"]).count() == 50 and kept.rows.count() == 50


def test_one_key_with_a_third_of_all_rows(spark, tmp_path):
    kept = KeyedStore(spark, str(tmp_path / "store"), spark.createDataFrame([], FORM).schema, "article_hash", buckets=4)
    rows = spark.range(0, 30_000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id % 500) end article_hash", "30000 - id as pos", "'t' text")
    added = {r.article_hash: r.pos for r in kept.add(rows, ["pos"]).collect()}
    assert len(added) == kept.rows.count() == 501 and added["hot"] == 3
    assert kept.add(spark.createDataFrame([], FORM), ["pos"]).count() == 0
