"""Exact duplicates: link and hash lookups, title windows, and the reasons rows drop out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import sort_key
from tidewire.functions.text import canonical_url, lookup_title_hash, nz
from tidewire.operators.anchors import first_for_a_while
from tidewire.operators.store import queue, visible


#: Why an item is dropped, in the order that is tried.
REASONS = ("cutoff", "scope", "raw_dedup", "hash_dedup", "unresolved")


def unknown_raw_links(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose raw link is not stored by anyone, irrelevant rows included; rows without a link stay."""
    known = stored.where(nz(F.col("raw_link")).isNotNull()).select(F.md5("raw_link").alias("_h")).distinct()
    return incoming.join(known, F.md5(nz(F.col("raw_link"))) == F.col("_h"), "left_anti")


def unknown_hashes(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose article hash no visible row has."""
    known = stored.where(~F.col("summary_status").eqNullSafe("irrelevant")).select("article_hash").distinct()
    return incoming.join(known, "article_hash", "left_anti")


def cross_url_duplicates(articles: DataFrame, link: Column) -> DataFrame:
    """Rows whose resolved URL's hash belongs to another visible article."""
    owners = articles.where(~F.col("summary_status").eqNullSafe("irrelevant")).select(F.md5(canonical_url(link)).alias("url_hash"), F.col("article_hash").alias("owner"))
    least = owners.groupBy("url_hash").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"))
    rows = articles.withColumn("url_hash", F.md5(canonical_url(link))).join(least, "url_hash")
    # another owner exists if the least or the greatest one is another
    return rows.withColumn("owner", F.when(F.col("lo") != F.col("article_hash"), F.col("lo")).when(F.col("hi") != F.col("article_hash"), F.col("hi"))).where("owner is not null").drop("lo", "hi")


def title_duplicates(articles: DataFrame, since: str, mode: str = "reference") -> DataFrame:
    """article_hash, match: rows with the title of another row since a time.

    reference: any other visible row, so both of a pair may go; the match is the newest. keep_first: the row collected first stays, the match.
    """
    rows = articles.select("article_hash", "collected_at", "summary_status", "title_hash", lookup_title_hash(F.col("title")).alias("lookup"), sort_key(F.col("published_at"), F.col("collected_at"), F.col("article_hash")).alias("sort_key"))
    if mode == "keep_first":
        # a common title is one key: its first row comes from partial aggregates, and Spark may split or broadcast the join
        first = rows.groupBy("lookup").agg(F.min(F.struct("collected_at", "article_hash")).alias("first"))
        out = rows.join(first, "lookup").withColumn("match", F.col("first.article_hash"))
        return out.where("match <> article_hash").select("article_hash", "match")
    seen = rows.where(~F.col("summary_status").eqNullSafe("irrelevant") & (F.col("sort_key") >= since)).select("title_hash", "sort_key", F.col("article_hash").alias("other"))
    # the newest two of each title: one of them is another row
    top = seen.groupBy("title_hash").agg(F.max(F.struct("sort_key", "other")).alias("a"))
    rest = seen.join(top, "title_hash").where("other <> a.other").groupBy("title_hash").agg(F.max(F.struct("sort_key", "other")).alias("b"))
    pairs = top.join(rest, "title_hash", "left").withColumnRenamed("title_hash", "lookup")
    joined = rows.drop("title_hash").join(pairs, "lookup")
    match = F.when(F.col("a.other") != F.col("article_hash"), F.col("a.other")).otherwise(F.col("b.other"))
    return joined.select("article_hash", match.alias("match")).where("match is not null")


def run_titles(articles: DataFrame, since: str, mode: str = "reference") -> DataFrame:
    """article_hash, dedup_decision, dedup_layer, dedup_match over every row."""
    found = title_duplicates(articles, since, mode)
    return articles.select("article_hash").join(found, "article_hash", "left").select("article_hash", F.when(F.col("match").isNull(), "new").otherwise("duplicate").alias("dedup_decision"), F.when(F.col("match").isNotNull(), F.lit(1)).alias("dedup_layer"), F.col("match").alias("dedup_match"))


def _moment(at: Column) -> Column:
    """Microseconds of an ISO time with a zone."""
    return F.unix_micros(F.try_to_timestamp(at))


def rolling_titles(articles: DataFrame, hours: float = 72) -> DataFrame:
    """article_hash, dedup_decision, dedup_match: of the rows with one title the first collected stays, and hides the others for `hours`; then the next one stays."""
    rows = articles.select(lookup_title_hash(F.col("title")).alias("key"), _moment(F.col("collected_at")).alias("at"), F.col("article_hash").alias("id"))
    found = first_for_a_while(rows, int(hours * 3_600_000_000))
    return found.select(F.col("id").alias("article_hash"), F.when(F.col("match").isNull(), "new").otherwise("duplicate").alias("dedup_decision"), F.col("match").alias("dedup_match"))


def run_pending(articles: DataFrame, hours: float = 72, mode: str = "keep_first", since: str = "") -> DataFrame:
    """What a run writes to the pending rows of the queue: article_hash, dedup_decision, dedup_layer, dedup_reason, dedup_match_hash, dedup_score.

    keep_first: visible rows outside the queue stay as they are, and hide pending ones of their title for `hours` as kept ones do.
    reference: any other visible row with the title since `since` hides a row, so both of a pair may go; the match is the newest.
    """
    pending = queue(articles, "pending")
    if mode == "keep_first":
        key = lambda frame: frame.select(lookup_title_hash(F.col("title")).alias("key"), _moment(F.col("collected_at")).alias("at"), F.col("article_hash").alias("id"))
        others = articles.join(pending.select("article_hash"), "article_hash", "left_anti")
        stays = visible(others).where(~F.col("dedup_decision").eqNullSafe("duplicate"))
        found = first_for_a_while(key(pending), int(hours * 3_600_000_000), key(stays)).select(F.col("id").alias("article_hash"), "match")
    else:
        hits = title_duplicates(articles, since)
        found = pending.select("article_hash").join(hits, "article_hash", "left")
    hit = F.col("match").isNotNull()
    return found.select(
        "article_hash", F.when(hit, "duplicate").otherwise("new").alias("dedup_decision"), F.when(hit, 1).alias("dedup_layer"),
        F.when(hit, "same_title").alias("dedup_reason"), F.col("match").alias("dedup_match_hash"), F.lit(None).cast("double").alias("dedup_score"),
    )


def primary_by_id(items: DataFrame) -> DataFrame:
    """id_hash, primary: the earliest new row."""
    return items.where("status = 'new'").groupBy("id_hash").agg(F.min_by("rowid", F.struct("created_at", "rowid")).alias("primary"))


def latest_by_title(items: DataFrame, since: float) -> DataFrame:
    """title_hash, latest: the latest new row since a time."""
    return items.where((F.col("status") == "new") & (F.col("created_at") >= since)).groupBy("title_hash").agg(F.max_by("rowid", F.struct("created_at", "rowid")).alias("latest"))


def drop_reasons(items: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """The first reason that holds, in order; null for rows that stay."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return items.withColumn("drop_reason", out)


def run_funnel(items: DataFrame, source: str = "source") -> DataFrame:
    """Counts by source of rows found, dropped for each reason, and new."""
    counts = [F.count_if(F.coalesce(F.col("drop_reason") == n, F.lit(False))).alias(f"dropped_{n}") for n in REASONS]
    out = items.groupBy(source).agg(F.count("*").alias("found"), *counts, F.count_if(F.col("drop_reason").isNull()).alias("new"))
    return out.withColumn("duplicate", F.col("dropped_raw_dedup") + F.col("dropped_hash_dedup"))
