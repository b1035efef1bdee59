"""Slots are counted out of a few ranges, so their number decides nothing that reaches the driver."""

from pyspark.sql import functions as F

from tidewire.operators import laid_out
from tidewire.plans import views


def test_slots_are_counted_out_of_ranges(spark, sf, tmp_path, monkeypatch):
    asked = []
    frame = type(spark.range(1))
    own = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: (asked.append(a[0]), own(self, *a))[1])
    monkeypatch.setattr(laid_out, "RANGE_ROWS", 60)
    articles = views.articles(spark, sf)
    laid = laid_out.lay_out(articles, str(tmp_path / "feed"), 10)
    rows = spark.read.parquet(str(tmp_path / "feed/latest"))
    sizes = [r["count"] for r in rows.groupBy("slot").count().collect()]
    bounds = sorted((r.low, r.high) for r in rows.groupBy("slot").agg(F.min("sort_key").alias("low"), F.max("sort_key").alias("high")).collect())
    assert max(sizes) == 10 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    assert max(n for n in asked if isinstance(n, int)) <= -(-rows.count() * 2 // 60)
    page, _ = laid.page(15)
    want = [r.sort_key for r in rows.orderBy(F.desc("sort_key")).limit(15).collect()]
    assert [r.sort_key for r in page.collect()] == want and len(laid.slots) <= 4
