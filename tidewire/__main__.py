"""python -m tidewire --store PATH: stage runs over a store of articles, in order; without a stage, the usual four.

What calls out is named as module:function: --fetcher (from a link to a page) and --asker (from a prompt to an answer).
A stage that lacks what it needs is skipped.
"""

from __future__ import annotations

import argparse
import importlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.dates import cutoff_days
from tidewire.plans.stages import USUAL, ArticleRuns, collected
from tidewire.plans.storage import exists
from tidewire.sources import readers
from tidewire.sources.feed_source import FeedSource

STAGES = ("collect", "classify", "fetch", "dedup", "retry-failed", "summarize", "status", "validate-feeds", "sources-list")


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tidewire", description=__doc__)
    p.add_argument("--store", required=True)
    for stage in STAGES:
        p.add_argument(f"--{stage}", action="store_true")
    p.add_argument("--sources", help="a YAML catalog")
    p.add_argument("--active-only", action="store_true", help="list only active sources")
    p.add_argument("--polls", help="a folder of polls, <host>/<source_id>/<poll>.xml")
    p.add_argument("--companies", default="", help="tags to collect for, with commas between")
    p.add_argument("--backfill", action="store_true", help="all polls once more, with the wide look-back")
    p.add_argument("--hours-back", type=float)
    p.add_argument("--days-back", type=float, default=1)
    p.add_argument("--backfill-days", type=int, default=365)
    p.add_argument("--cap", type=int, help="entries of a feed that are looked at")
    p.add_argument("--fetcher")
    p.add_argument("--asker")
    p.add_argument("--model", default="")
    p.add_argument("--out", help="a folder for pages and summaries")
    p.add_argument("--buckets", type=int, default=256)
    return p


def named(what: str) -> Callable:
    module, _, name = what.partition(":")
    return getattr(importlib.import_module(module), name)


def polled_items(polls: DataFrame) -> DataFrame:
    """Entries of polls as items of a collection; the source is the feed's folder."""
    at = F.to_utc_timestamp(readers.rss_date(F.col("published")), F.current_timezone())
    return polls.select(
        F.col("feed").alias("source_id"), (F.col("poll").cast("long") * 1_000_000 + F.col("pos")).alias("pos"), readers.strip_html(F.col("title")).alias("title"), "link",
        F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias("published_at"), readers.strip_html(F.col("summary")).alias("summary_text"), F.lit("").alias("image_url"),
    )


def collect(spark: SparkSession, runs: ArticleRuns, sources: DataFrame, args: argparse.Namespace, now: float) -> dict[str, object]:
    """What is new in the polls since the last run, as a stream that ends; a backfill reads all of them."""
    spark.dataSource.register(FeedSource)
    days = cutoff_days("backfill" if args.backfill else "normal", args.backfill_days, args.hours_back, args.days_back)
    cutoff, totals = F.timestamp_seconds(F.lit(now - days * 86400)), []

    def take(polls: DataFrame, _: int = 0) -> None:
        funnel = runs.collect(polled_items(polls), sources, iso(now), cutoff, args.cap)
        totals.append(collected(funnel.rows, sources))
        funnel.drop()

    if args.backfill:
        take(spark.read.format("feeds").load(args.polls))
    else:
        stream = spark.readStream.format("feeds").load(args.polls)
        stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{args.store}/polled").trigger(availableNow=True).start().awaitTermination()
    if not totals:
        return {"sources_ok": sources.count(), "sources_error": 0, "items_found": 0, "items_new": 0, "items_duplicate": 0}
    return totals[0] | {k: sum(t[k] for t in totals) for k in ("items_found", "items_new", "items_duplicate")}


def iso(seconds: float) -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(seconds))


def main(argv: list[str] | None = None, spark: SparkSession | None = None, clock: Callable[[], float] = time.time) -> list[str]:
    """Prints, and gives, what the stages came to."""
    args = options().parse_args(argv)
    asked = [s for s in STAGES if getattr(args, s.replace("-", "_"))] or list(USUAL)
    spark = spark or SparkSession.builder.getOrCreate()
    began, said = clock(), []
    runs = ArticleRuns(spark, args.store, args.buckets)
    run = time.strftime("%Y%m%dT%H%M%SZ", time.gmtime(began))
    text = "\n".join(r.value for r in spark.read.text(args.sources, wholetext=True).collect()) if args.sources else None
    listed = readers.catalog(spark, text)
    active = readers.in_scope(listed.where("active"), [c.strip() for c in args.companies.split(",") if c.strip()])
    lacks = {"collect": not (args.polls and args.sources), "fetch": not (args.fetcher and args.out), "summarize": not args.asker, "validate-feeds": not args.fetcher}
    work: dict[str, Callable[[], dict[str, object]]] = {
        "collect": lambda: collect(spark, runs, active, args, began),
        "classify": runs.classify,
        "fetch": lambda: runs.fetch(named(args.fetcher), f"{args.out}/pages", run),
        "dedup": runs.dedup,
        "retry-failed": runs.retry,
        "summarize": lambda: runs.summarize(named(args.asker), iso(clock()), args.model, folder=f"{args.out}/summaries" if args.out else None, run=run),
    }
    try:
        for stage in asked:
            if lacks.get(stage):
                said.append(f"{stage}: not configured, skipping")
            elif stage == "status":
                said += [f"{r.section} {r.name}: {r.n}" for r in runs.status(listed).collect()]
            elif stage == "sources-list":
                rows = listed.where("active") if args.active_only else listed
                said += [f"[{'active' if r.active else 'disabled'}] {r.source_id}: {r.name} ({r.source_type}/{r.category})" for r in rows.orderBy("source_id").collect()]
            elif stage == "validate-feeds":
                urls = listed.where("active").withColumn("url", readers.feed_url(listed))
                bodies = urls.join(readers.fetched(urls.where("feed_type <> 'linkedin_company'"), named(args.fetcher)), "url").select("source_id", "body", "error")
                said += [f"{r.source_id}: {r.n}" for r in readers.probed(urls, bodies).orderBy("source_id").collect()]
            else:
                runs.staged(stage, work[stage], clock)
    finally:
        if exists(spark, f"{args.store}/report"):
            said += [r.text for r in runs.report(began).collect()]
        print("\n".join(said))
    return said


if __name__ == "__main__":
    main()
