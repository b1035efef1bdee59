"""Articles and summaries as Markdown and JSON rows, and files of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import article_slug, object_key, summary_slug

#: Front matter keys and the columns they show, and those of a summary's JSON.
FRONT = (("id_hash", "article_hash"), ("source", "source_id"), ("category", "category"), ("tag", "tag"), ("product_line", "product_line"), ("event_type", "event_type"), ("alert_level", "alert_level"), ("date", "published_at"), ("image_url", "image_url"), ("url", "link"))
SUMMARY = ("id_hash", "source", "source_name", "category", "tag", "product_line", "event_type", "alert_level", "date", "image_url", "url", "ai_model", "ai_processed_at", "title", "summary", "competitor_analysis")


def _field(articles: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in articles.columns else F.lit("")


def markdown(articles: DataFrame, body: str = "markdown") -> DataFrame:
    """slug, content: front matter, heading, URL line and body."""
    front = F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{k}: "), _field(articles, c)) for k, c in FRONT), F.lit("---"))
    content = F.concat(front, F.lit("\n\n# "), _field(articles, "title"), F.lit("\n\nURL: "), _field(articles, "link"), F.lit("\n\n"), _field(articles, body))
    return articles.select("article_hash", "source_id", article_slug(F.col("source_id"), F.col("article_hash")).alias("slug"), content.alias("content"))


def with_keys(rows: DataFrame, prefix: str, run: str) -> DataFrame:
    return rows.withColumn("key", object_key(prefix, run, F.col("source_id"), F.col("slug")))


def summary_json(articles: DataFrame) -> DataFrame:
    """slug, content: one JSON object for each article."""
    columns = dict(FRONT)
    fields = [_field(articles, columns.get(k, k)).alias(k) for k in SUMMARY]
    source = F.coalesce(F.nullif(F.col("source_id"), F.lit("")), F.lit("unknown"))
    return articles.select("article_hash", source.alias("source_id"), summary_slug(source, F.col("article_hash")).alias("slug"), F.to_json(F.struct(*fields)).alias("content"))


def summary_markdown(items: DataFrame) -> DataFrame:
    return items.select("slug", F.concat(F.lit("# Summary: "), "title", F.lit("\nURL: "), "url", F.lit("\n\n"), "summary").alias("content"))


def quotes_json(quotes: DataFrame) -> DataFrame:
    """One object of all quotes, which are a handful of listed companies."""
    return quotes.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("company", "price", "change_percent", "currency", "scraped_at"))).alias("items"))).alias("content"))


def write_documents(rows: DataFrame, folder: str, run: str) -> None:
    """Contents as text by run and source; the executors write, a directory for each source."""
    rows.select(F.lit(run).alias("run_ts"), "source_id", F.col("content").alias("value")).write.partitionBy("run_ts", "source_id").mode("append").text(folder)
