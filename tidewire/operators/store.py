"""The article store: idempotent inserts, versions, the work queue, counts and upkeep.

Rows are appended and read as the latest version of each key; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import rules
from tidewire.functions.dates import sort_key, sort_ts
from tidewire.functions.text import companies, nz
from tidewire.plans.storage import cut_lineage

#: Defaults of absent attributes.
DEFAULTS = {"title": "", "link": "", "category": "auto", "content_kind": "news", "summary_status": "pending", "dedup_decision": "", "source_name": "", "image_url": "", "summary": "", "action_description": "", "competitor_analysis": "", "event_type": "", "alert_level": ""}
QUEUE_CATEGORIES = ("auto", "economia", "tecnologia")
PUBLIC_TEXT = ("article_hash", "title", "link", "image_url", "summary", "action_description", "competitor_analysis", "category", "event_type", "alert_level", "summary_status", "published_at", "source_name")


def full(articles: DataFrame) -> DataFrame:
    """Every attribute present: blanks and nulls take the default, index keys go."""
    own = [c for c in articles.columns if c not in ("sort_key", "version")]
    return articles.select(*(F.coalesce(nz(F.col(c)), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in own))


def base_rows(articles: DataFrame) -> DataFrame:
    """As stored: blanks are nulls, with the sort key."""
    texts = [f.name for f in articles.schema if f.dataType.simpleString() == "string"]
    return articles.select(*(nz(F.col(c)).alias(c) if c in texts else F.col(c) for c in articles.columns), sort_key(F.col("published_at"), F.col("collected_at"), F.col("article_hash")).alias("sort_key"))


def company_rows(articles: DataFrame) -> DataFrame:
    """A row for each company of an article, published_at being the sort time."""
    return articles.select("article_hash", F.explode(companies(F.col("tag"))).alias("company"), "title", "link", sort_ts(F.col("published_at"), F.col("collected_at")).alias("published_at"), "category", "content_kind", "summary_status", "dedup_decision", "source_name")


def public(articles: DataFrame) -> DataFrame:
    """Neither irrelevant nor duplicate; an absent attribute is not a different one."""
    return articles.where(~F.col("summary_status").eqNullSafe("irrelevant") & ~F.col("dedup_decision").eqNullSafe("duplicate"))


def public_shape(articles: DataFrame, *more: str) -> DataFrame:
    """The sixteen public fields with defaults, and `more` columns; nothing else internal."""
    has = set(articles.columns)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) if name in has else F.lit("").alias(name)

    empty = F.array().cast("array<string>")
    one = F.when(nz(F.col("company")).isNotNull(), F.array("company")) if "company" in has else F.lit(None).cast("array<string>")
    firms = F.coalesce(F.col("companies") if "companies" in has else one, one, empty)
    image = nz(F.col("image_url")) if "image_url" in has else F.lit(None).cast("string")
    images = F.when(F.size("image_urls") > 0, F.col("image_urls")) if "image_urls" in has else F.lit(None).cast("array<string>")
    kind = F.coalesce(F.col("content_kind"), F.lit("news")) if "content_kind" in has else F.lit("news")
    return articles.select(*(text(c) for c in PUBLIC_TEXT), F.coalesce(images, F.when(image.isNotNull(), F.array(image)), empty).alias("image_urls"), kind.alias("content_kind"), firms.alias("companies"), *more)


def insert_new(incoming: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """Rows whose article_hash is not stored; of several, the first in `order`."""
    first = Window.partitionBy("article_hash").orderBy(*order)
    fresh = incoming.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return fresh.join(stored.select("article_hash").distinct(), "article_hash", "left_anti")


def current(versions: DataFrame) -> DataFrame:
    """The latest version of each article."""
    last = Window.partitionBy("article_hash").orderBy(F.desc("version"))
    return versions.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def update(articles: DataFrame, changes: DataFrame, version: int) -> DataFrame:
    """New versions: columns of `changes` (with article_hash) over the stored ones; unknown hashes give nothing."""
    fresh = [c for c in changes.columns if c != "article_hash"]
    renamed = changes.select("article_hash", *(F.col(c).alias(f"_{c}") for c in fresh))
    joined = articles.drop("version").join(renamed, "article_hash")
    return joined.select(*(F.col(f"_{c}").alias(c) if c in fresh else F.col(c) for c in articles.columns if c != "version"), F.lit(version).alias("version"))


def marked(articles: DataFrame, marks: DataFrame, version: int) -> DataFrame:
    """New versions of the articles in marks (article_hash, status, error): irrelevant, or failed with its error in `extra`; what an irrelevant one had there stays."""
    known = marks.where(F.col("status").isin("irrelevant", "failed")).groupBy("article_hash").agg(F.max(F.struct("status", "error")).alias("m"))  # irrelevant goes before failed
    own = articles.select("article_hash", (F.col("extra") if "extra" in articles.columns else F.lit(None).cast("string")).alias("_own"))
    changes = known.join(own, "article_hash").select("article_hash", F.col("m.status").alias("summary_status"), F.when(F.col("m.status") == "failed", F.coalesce("m.error", F.lit(""))).otherwise(F.col("_own")).alias("extra"))
    return update(articles if "extra" in articles.columns else articles.withColumn("extra", F.lit(None).cast("string")), changes, version)


def found_by_hash(articles: DataFrame, article_hash: str, exclude: str | None = None) -> DataFrame:
    """The visible article of a hash, or no row; a row never finds itself."""
    return by_hash(visible(articles), article_hash).where(F.lit(article_hash != exclude))


def found_by_raw_link(articles: DataFrame, raw_link: str) -> DataFrame:
    """One article of a raw link, irrelevant or not; nothing of an empty link."""
    return full(articles.where(F.col("raw_link") == nz(F.lit(raw_link)))).orderBy("article_hash").limit(1)


def found_by_title_hash(articles: DataFrame, title_hash: str, since: str, exclude: str | None = None) -> DataFrame:
    """The newest visible article with a stored title hash since a time, another one than `exclude`."""
    rows = articles.withColumn("_key", sort_key(F.col("published_at"), F.col("collected_at"), F.col("article_hash")))
    rows = visible(rows).where((F.col("title_hash") == title_hash) & (F.col("_key") >= since) & ~F.col("article_hash").eqNullSafe(F.lit(exclude)))
    return full(rows.orderBy(F.desc("_key")).limit(1).drop("_key"))


def queue(articles: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """Work by collection time: status and category fit, not a duplicate; no limit if 0 or None."""
    out = articles.where((F.col("summary_status") == status) & F.col("category").isin(*QUEUE_CATEGORIES) & ~F.col("dedup_decision").eqNullSafe("duplicate"))
    out = out.orderBy("collected_at", "article_hash")
    return out.limit(limit) if limit else out


def retried(articles: DataFrame) -> DataFrame:
    """Failed rows of the queue become pending again."""
    back = (F.col("summary_status") == "failed") & F.col("category").isin(*QUEUE_CATEGORIES) & ~F.col("dedup_decision").eqNullSafe("duplicate")
    return articles.withColumn("summary_status", F.when(back, "pending").otherwise(F.col("summary_status")))


def reclassified(articles: DataFrame) -> DataFrame:
    """Pending rows with event_type, alert_level and is_launch from the rules."""
    v = rules.classify_article(F.col("title"), F.col("action_description"))
    return queue(articles, "pending").select("article_hash", v["event_type"].alias("event_type"), v["alert_level"].alias("alert_level"), v["is_launch"].alias("is_launch"))


def visible(articles: DataFrame) -> DataFrame:
    return articles.where(~F.col("summary_status").eqNullSafe("irrelevant"))


def count_by_status(articles: DataFrame) -> DataFrame:
    return articles.groupBy(F.coalesce("summary_status", F.lit("")).alias("summary_status")).agg(F.count("*").alias("n"))


def count_by_category(articles: DataFrame) -> DataFrame:
    return visible(articles).groupBy("category").agg(F.count("*").alias("n"))


def backfilled_kind(articles: DataFrame) -> DataFrame:
    """Rows without a kind are social if their feed is, else news."""
    return articles.withColumn("content_kind", F.coalesce(nz(F.col("content_kind")), F.when(F.col("feed_type") == "linkedin_company", "social").otherwise("news")))


def stale_status_keys(articles: DataFrame) -> DataFrame:
    """Audit: queue rows whose stored status key is not that of their status."""
    return articles.where(F.col("summary_status").isin("pending", "failed") & ~F.col("status_key").eqNullSafe(F.concat(F.lit("STATUS#"), F.col("summary_status"))))


def unsummarized(items: DataFrame) -> DataFrame:
    return items.where((F.col("status") == "new") & F.col("summarized_at").isNull()).orderBy("created_at", "rowid")


def cleared_summaries(items: DataFrame) -> DataFrame:
    return items.withColumn("summarized_at", F.when(F.col("status") == "new", F.lit(None)).otherwise(F.col("summarized_at")))


def ensure(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """The named table, made empty if there is none."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")
    return spark.table(name)


def cleared(spark: SparkSession, name: str, sure: bool = False) -> int:
    """How many rows a table holds; they go only if the caller is sure."""
    n = spark.table(name).count()
    if sure:
        spark.sql(f"TRUNCATE TABLE {name}")
    return n


def numbered(items: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """items with rowid from after + 1 without gaps, in order; ties fall anyhow. Each range of rows is numbered by itself, and only the ranges' sizes meet."""
    rows = cut_lineage(items.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_own", own).join(before, "_range").withColumn("rowid", F.col("_own") + F.col("_before") + F.lit(after)).drop("_range", "_own", "_before")


def by_hash(articles: DataFrame, article_hash: str) -> DataFrame:
    """The article of a hash with every attribute, or no row."""
    return full(articles.where(F.col("article_hash") == article_hash))


def with_feed(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with the feed_type and content_kind of their source; of an unknown one, plain search news."""
    own = sources.select("source_id", F.col("feed_type").alias("_type"), F.col("content_kind").alias("_kind"))
    out = articles.drop("feed_type", "content_kind").join(own, "source_id", "left")
    return out.withColumns({"feed_type": F.coalesce("_type", F.lit("google_news_query")), "content_kind": F.coalesce("_kind", F.lit("news"))}).drop("_type", "_kind")
