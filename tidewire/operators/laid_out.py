"""Feeds over a table that lies in the order it is read in.

Public rows are written once by range of their sort key, newest first, a folder for each slot; a second copy lies by
company and sort key. A manifest has a row for each slot (and company) with its bounds and counts by kind. A page asks the
manifest for the few slots that can hold its rows, reads those folders alone, and takes limit + 1 rows in one job: the
first page and the five-hundredth cost the same, whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewire.functions.payloads import decode_cursor, encode_cursor
from tidewire.functions.text import companies
from tidewire.operators.feed import checked_kind, checked_limit, keyed, within
from tidewire.operators.store import public, public_shape

#: Rows of a slot; the last of a range has fewer.
SLOT_ROWS = 50_000
#: Rows of a range, nearly: ranges are found by sampling, which sends keys of each to the driver; slots are cut out of them by counting.
RANGE_ROWS = 50_000
KINDS = ("news", "social")


def lay_out(articles: DataFrame, path: str, slot_rows: int = SLOT_ROWS) -> LaidOut:
    """Writes the public rows of articles under a path, by time and by company and time, with their manifests."""
    rows = keyed(public(articles)).withColumn("kind", F.coalesce("content_kind", F.lit("news")))
    tagged = rows.withColumn("company", F.explode(F.array_distinct(companies(F.col("tag")))))
    for name, frame, order in (("latest", rows, []), ("companies", tagged, ["company"])):
        by = [*(F.col(c) for c in order), F.desc("sort_key")]
        n = frame.count()
        ordered = frame.repartitionByRange(max(1, -(-n // max(slot_rows, RANGE_ROWS))), *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
        in_range, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))  # the range, and the place there from 0
        ranged = ordered.withColumn("slot", in_range * (n // slot_rows + 1) + F.floor(at / slot_rows)).drop("_at")
        ranged.sortWithinPartitions("slot", *by).write.mode("overwrite").partitionBy("slot").parquet(f"{path}/{name}")
        ranged.limit(0).write.mode("overwrite").parquet(f"{path}/{name}_columns")  # what an empty table has no file to tell
        written = articles.sparkSession.read.schema(ranged.schema).parquet(f"{path}/{name}")
        counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
        manifest = written.groupBy(*order, "slot").agg(F.min("sort_key").alias("low"), F.max("sort_key").alias("high"), F.count("*").alias("n"), *counts)
        manifest.repartitionByRange(*order, "high").write.mode("overwrite").parquet(f"{path}/{name}_manifest")
    return LaidOut(articles.sparkSession, path)


class LaidOut:
    """Pages of what lay_out() wrote. `slots`: the slots that the last page read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.slots = spark, path, []
        self._schemas = {n: spark.read.parquet(f"{path}/{n}_columns").schema for n in ("latest", "companies")}
        self._manifests = {n: spark.read.parquet(f"{path}/{n}_manifest") for n in ("latest", "companies")}

    def _chosen(self, name: str, names: list[str], kind: str | None, below: str | None, since: str | None, until: str | None, take: int) -> list[int]:
        """Of each company asked for, the slots from the bounds down that hold `take` rows for sure; a slot that reaches over a bound counts for none."""
        manifest, count = self._manifests[name], F.col(kind or "n")
        fits = (count > 0) & (F.col("low") < below if below else F.lit(True)) & (F.col("high") >= since if since else F.lit(True)) & (F.col("low") <= until + "￿" if until else F.lit(True))
        rows = manifest.where(fits).withColumn("sure", count)
        if names:
            newest = Window.partitionBy("company").orderBy(F.desc("high"))
            rows = rows.where(F.col("company").isin(names)).withColumn("at", F.row_number().over(newest)).where(F.col("at") <= take + 2)
        else:
            rows = rows.orderBy(F.desc("high")).limit(take + 2)
        held: dict[str, int] = {}
        out = set()
        for r in sorted(rows.collect(), key=lambda r: r.high, reverse=True):  # `take` and two for each name at most
            own = r.company if names else ""
            if held.get(own, 0) < take:
                out.add(r.slot)
                whole = (not below or r.high < below) and (not until or r.high <= until + "￿") and (not since or r.low >= since)
                held[own] = held.get(own, 0) + (r.sure if whole else 0)
        return sorted(out)

    def _read(self, name: str, slots: list[int]) -> DataFrame:
        reader = self.spark.read.schema(self._schemas[name]).option("basePath", f"{self.path}/{name}")
        return reader.parquet(*(f"{self.path}/{name}/slot={s}" for s in slots)) if slots else self.spark.createDataFrame([], self._schemas[name])

    def page(self, limit: object = None, kind: str | None = None, cursor: str | None = None, names: list[str] | None = None, since: str | None = None, until: str | None = None) -> tuple[DataFrame, str | None]:
        """The newest public rows in public shape with their sort_key, and the cursor of the next page (none at the end).

        names: only rows of these companies, each under the first asked for. since, until: bounds on the sort key.
        """
        n, kind, key = checked_limit(limit), checked_kind(kind), decode_cursor(cursor)
        below, asked = key["sort_key"] if key else None, [x for x in names or [] if x]
        name = "companies" if asked else "latest"
        self.slots = self._chosen(name, asked, kind, below, since, until, n + 1)
        rows = self._read(name, self.slots).where(within(since, until) & (F.col("sort_key") < below if below else F.lit(True)))
        if kind:
            rows = rows.where(F.col("kind") == kind)
        if asked:
            place = F.array_position(F.array(*map(F.lit, asked)), F.col("company"))
            rows = rows.where(F.col("company").isin(asked)).withColumn("place", place)
            first = Window.partitionBy("article_hash").orderBy("place")
            rows = rows.withColumn("first", F.row_number().over(first)).where("first = 1").drop("first", "place")
        shaped = public_shape(rows, "sort_key")
        found: list[Row] = shaped.orderBy(F.desc("sort_key")).limit(n + 1).collect()
        page = self.spark.createDataFrame(found[:n], shaped.schema)
        return page, encode_cursor({"sort_key": found[n - 1].sort_key}) if len(found) > n else None
