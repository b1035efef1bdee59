"""What runs come to: collection, summaries, stages, and the state of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidewire.operators.dedup import REASONS
from tidewire.operators.store import count_by_category, count_by_status, visible


def collect_totals(runs: DataFrame) -> DataFrame:
    """One row of totals over a collection's runs (source, status, found, new, duplicate): items count where the run was ok, every other run is an error."""
    ok = F.col("status").eqNullSafe("ok")

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(ok, F.col(name))), F.lit(0)).cast("long").alias(name)

    return runs.agg(total("found"), total("new"), total("duplicate"), F.count_if(ok).alias("sources_ok"), F.count_if(~ok).alias("sources_error"))


def _funnel_counts() -> list[Column]:
    dropped = [F.count_if(F.col("drop_reason").eqNullSafe(n)).alias(f"dropped_{n}") for n in REASONS]
    return [F.count(F.lit(1)).alias("found"), *dropped, F.count_if(F.col("drop_reason").isNull()).alias("new")]


def counted(items: DataFrame, name: str = "funnel") -> tuple[DataFrame, Observation]:
    """items (drop_reason) that count themselves as they are written, and where the counts are found then: found, dropped by each reason, new. One job, where an aggregate would be a second one."""
    counts = Observation(name)
    return items.observe(counts, *_funnel_counts()), counts


def counted_stream(items: DataFrame, name: str = "funnel") -> DataFrame:
    """A stream whose batches count themselves, for BatchCounts of that name."""
    return items.observe(name, *_funnel_counts())


class BatchCounts(StreamingQueryListener):
    """Keeps a row of counts for each batch of the streams that count under a name; batches without rows have none. spark.streams.addListener(it)."""

    FORM = "query string, batch long, found long, " + ", ".join(f"dropped_{n} long" for n in REASONS) + ", new long, seconds double"

    def __init__(self, name: str = "funnel"):
        self.name, self.rows = name, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        x = event.progress
        counts = x.observedMetrics.get(self.name)
        if counts is not None and counts["found"]:
            self.rows.append((str(x.name or x.id), x.batchId, *(int(c) for c in counts), x.batchDuration / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.FORM)


def collect_errors(runs: DataFrame) -> DataFrame:
    """source, error of runs that ended in an error; raised ones are counted above but not listed."""
    return runs.where("status = 'error'").select("source", "error")


def summary_totals(outcomes: DataFrame) -> DataFrame:
    """One row of totals over summaries (relevant, error)."""
    failed = F.col("error").isNotNull()
    irrelevant = ~failed & F.col("relevant").eqNullSafe(False)
    return outcomes.agg(F.count_if(~failed & ~irrelevant).alias("summarized"), F.count_if(irrelevant).alias("irrelevant"), F.count_if(failed).alias("failed"))


def stage_lines(stages: DataFrame) -> DataFrame:
    """stages (stage, started_at, ended_at in seconds, success, details map) with text: state, name, duration, and a line for each detail by name."""
    head = F.format_string("  [%s] %s (%.1fs)", F.when(F.col("success"), "OK").otherwise("FAIL"), F.col("stage"), F.col("ended_at") - F.col("started_at"))
    details = F.transform(F.array_sort(F.map_entries(F.coalesce("details", F.create_map().cast("map<string,string>")))), lambda d: F.concat(F.lit("         "), d["key"], F.lit(": "), F.coalesce(d["value"], F.lit(""))))
    return stages.select("stage", "started_at", F.array_join(F.concat(F.array(head), details), "\n").alias("text"))


def store_state(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """section, name, n: active sources, visible articles, and the latter by status and by category."""

    def part(rows: DataFrame, section: str, name: Column) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), name.alias("name"), F.col("n").cast("long").alias("n"))

    active = sources.where("active").agg(F.count("*").alias("n"))
    seen = visible(articles).agg(F.count("*").alias("n"))
    out = part(active, "sources", F.lit("active")).union(part(seen, "articles", F.lit("visible")))
    return out.union(part(count_by_status(articles), "status", F.col("summary_status"))).union(part(count_by_category(articles), "category", F.col("category")))
