"""Watermarked deduplication, event-time windows, a circuit breaker by host, and an idempotent sink."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.operators.keyed import KeyedStore
from tidewire.plans.storage import delete, gone_at_exit, shared_folder

#: Statuses that trip the breaker at once, failures in a row that do, and seconds.
TRIP_AT_ONCE, TRIP_AFTER, COOLDOWN, LEAST_WAIT, MOST_WAIT = (403, 429, 503, 999), 3, 60.0, 1.0, 300.0


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet path as a stream; event times become instants, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def first_seen(events: DataFrame, keys: list[str], late: str = "24 hours") -> DataFrame:
    """Each key once while the watermark remembers it: late repeats within a look-back are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, key: str, width: str = "1 hour", late: str = "24 hours", slide: str | None = None) -> DataFrame:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def session_counts(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "24 hours") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def breaker_step(failures: int, blocked_until: float, at: float, status: int, retry_after: float | None) -> tuple[int, float]:
    """The state after one response: success resets; a refusal, or the third failure in a row, blocks for a while."""
    if status < 400:
        return 0, 0.0
    failures += 1
    if status in TRIP_AT_ONCE or failures >= TRIP_AFTER:
        blocked_until = at + (COOLDOWN if retry_after is None else max(min(retry_after, MOST_WAIT), LEAST_WAIT))
    return failures, blocked_until


def breaker_batch(fetches: DataFrame) -> DataFrame:
    """host, id, failures, blocked_until after each response (host, id, at in seconds, status, retry_after), by gaps and islands: failures count from the last success, and the latest trip since then holds."""
    order = Window.partitionBy("host").orderBy("at", "id")
    rows = fetches.withColumn("island", F.sum((F.col("status") < 400).cast("int")).over(order))
    inside = Window.partitionBy("host", "island").orderBy("at", "id")
    rows = rows.withColumn("failures", F.sum((F.col("status") >= 400).cast("long")).over(inside))
    wait = F.when(F.col("retry_after").isNull(), COOLDOWN).otherwise(F.greatest(F.least("retry_after", F.lit(MOST_WAIT)), F.lit(LEAST_WAIT)))
    trips = (F.col("status") >= 400) & (F.col("status").isin(*TRIP_AT_ONCE) | (F.col("failures") >= TRIP_AFTER))
    until = F.coalesce(F.last(F.when(trips, F.col("at") + wait), ignorenulls=True).over(inside), F.lit(0.0))
    return rows.select("host", "id", "failures", until.alias("blocked_until"))


def ingest(stream: DataFrame, store: str, order: list[str], checkpoint: str) -> None:
    """Appends rows of unknown article_hash to a store by key, a batch at a time; a batch that comes again adds nothing, and each reads only the buckets that may hold its hashes."""
    kept = KeyedStore(stream.sparkSession, store, stream.schema, "article_hash")

    def add(batch: DataFrame, _: int) -> None:
        kept.add(batch, order)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def spaced(requests: DataFrame, delay: float = 0.25) -> DataFrame:
    """requests (host, id, at in seconds) with start: each waits for its own time and for `delay` after the start before it.

    start(i) = max over j <= i of at(j) + (i - j) * delay, which is a running maximum.
    """
    order = Window.partitionBy("host").orderBy("at", "id")
    rows = requests.withColumn("_n", F.row_number().over(order))
    return rows.withColumn("start", F.max(F.col("at") - F.col("_n") * delay).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n") * delay).drop("_n")


def within_window(batch: DataFrame, stored: DataFrame, now: float, hours: float = 72) -> DataFrame:
    """batch (rowid, title_hash) with status and match: the latest new row of the store (with status, created_at) since `hours` before now with its title hash, else the first of the batch."""
    known = stored.where((F.col("status") == "new") & (F.col("created_at") >= now - 3600 * hours)).groupBy("title_hash").agg(F.max_by("rowid", F.struct("created_at", "rowid")).alias("_old"))
    first = batch.groupBy("title_hash").agg(F.min("rowid").alias("_first"))
    out = batch.join(known, "title_hash", "left").join(first, "title_hash")
    match = F.coalesce("_old", F.when(F.col("_first") < F.col("rowid"), F.col("_first")))
    return out.select(*batch.columns, F.when(match.isNull(), "new").otherwise("dupe").alias("status"), match.alias("match"))


def ingest_windowed(stream: DataFrame, store: str, checkpoint: str, clock: Callable[[], float] = time.time, hours: float = 72) -> None:
    """Appends a stream's items (rowid, title_hash) to a Parquet store with status, match, created_at, judged against what the store holds of the last hours by the clock; a rowid that is stored is not added again."""
    spark = stream.sparkSession
    schema = spark.createDataFrame([], stream.schema).selectExpr("*", "cast(null as string) status", "cast(null as long) match", "cast(null as double) created_at").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], schema).write.parquet(store)

    def add(batch: DataFrame, _: int) -> None:
        now, held = clock(), spark.read.schema(schema).parquet(store)
        fresh = batch.dropDuplicates(["rowid"]).join(held.select("rowid"), "rowid", "left_anti").select(*batch.columns)
        rows = within_window(fresh, held, now, hours).withColumn("created_at", F.lit(now))
        rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)).write.mode("append").parquet(store)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives its output as a table in the shared folder, until the driver ends; its state goes at once."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    gone_at_exit(spark, folder)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    delete(spark, f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
