"""Several blocks whose partitions are not merged, and rows whose nearest are a few long vectors."""

import numpy as np
from pyspark.sql import functions as F

from tidewire.llm import ann


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 30)
    monkeypatch.setattr(ann, "SAMPLE", 200)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 64)) / 8
    x[rng.choice(1500, 12, replace=False)] *= 20
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(ann, "TARGET", 0.95)
    spark.conf.set(name, "false")
    try:
        rows = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    finally:
        spark.conf.unset(name)
    found = {(r.query_id, r.vec_id) for r in rows}
    score = x[::20] @ x.T
    score[np.arange(75), np.arange(0, 1500, 20)] = -np.inf
    want = {(20 * q, int(i)) for q, best in enumerate(np.argsort(-score, axis=1)[:, :20]) for i in best}
    assert len(rows) == 75 * 20 and len(found & want) >= 0.93 * len(want)
