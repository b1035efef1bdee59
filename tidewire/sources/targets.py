"""Crawl targets of several configuration files: merging, overrides, and pages as Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import nz, strip
from tidewire.sources.readers import fetched

TARGET = "file int, pos int, slug string, url string, title string, max_retries int, backoff_seconds double, min_content_chars int"
#: What holds where neither a target nor its file says otherwise.
DEFAULTS = {"max_retries": 2, "backoff_seconds": 5.0, "min_content_chars": 200}


def targets(spark: SparkSession, texts: list[str]) -> DataFrame:
    """The targets of YAML texts, one row each; the settings of a target are its `anti_block` entries."""
    import yaml

    rows = []
    for i, text in enumerate(texts):
        for k, x in enumerate((yaml.safe_load(text or "") or {}).get("targets") or []):
            own = x.get("anti_block") or {}
            rows.append((i, k, x.get("slug"), x.get("url"), x.get("title"), own.get("max_retries"), own.get("backoff_seconds") and float(own["backoff_seconds"]), own.get("min_content_chars")))
    return spark.createDataFrame(rows, TARGET)


def merged(rows: DataFrame) -> DataFrame:
    """One target for each slug: the last one's values at the first one's place."""
    values = [c for c in rows.columns if c not in ("file", "pos", "slug")]
    key = F.struct("file", "pos")
    out = rows.groupBy("slug").agg(F.min(key).alias("place"), F.max_by(F.struct(*values), key).alias("own"))
    return out.select("slug", "own.*", F.col("place.file").alias("file"), F.col("place.pos").alias("pos"))


def overridden(rows: DataFrame, common: dict[str, object] | None = None) -> DataFrame:
    """A target's own settings over the common ones over the defaults, each by itself."""
    held = DEFAULTS | {k: v for k, v in (common or {}).items() if k in DEFAULTS and v is not None}
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)).cast(rows.schema[k].dataType) for k, v in held.items()})


def crawled(rows: DataFrame, fetch: Callable[[str], str]) -> DataFrame:
    """slug, content, error of each target: its page as Markdown under a heading and its URL; a page without text is an error."""
    pages = fetched(rows, fetch).withColumnRenamed("url", "_url")
    out = rows.join(pages, F.col("url") == F.col("_url"), "left")
    body = nz(strip(F.col("body")))
    head = F.concat(F.lit("# "), F.coalesce(nz(F.col("title")), F.col("slug")), F.lit("\n\nURL: "), F.col("url"), F.lit("\n\n"))
    return out.select("slug", F.concat(head, body).alias("content"), F.when(body.isNull(), F.coalesce("error", F.lit("empty markdown"))).alias("error"))
