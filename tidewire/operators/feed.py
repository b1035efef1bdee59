"""Time-ordered feeds with exact keyset pages: limits count rows after every filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.dates import sort_key
from tidewire.functions.payloads import decode_cursor, encode_cursor
from tidewire.functions.text import companies
from tidewire.operators.store import public, public_shape

PAGE, MOST = 20, 100


def checked_limit(limit: object = None) -> int:
    """An integer of at least one, at most a hundred; twenty if none is given."""
    if limit is None:
        return PAGE
    if isinstance(limit, bool) or not str(limit).lstrip("+-").isdigit() or int(limit) < 1:
        raise ValueError("limit must be a positive integer")
    return min(int(limit), MOST)


def checked_kind(kind: str | None) -> str | None:
    if kind not in (None, "news", "social"):
        raise ValueError("kind must be news or social")
    return kind


def keyed(articles: DataFrame) -> DataFrame:
    return articles.withColumn("sort_key", sort_key(F.col("published_at"), F.col("collected_at"), F.col("article_hash")))


def after(cursor: str | None) -> Column:
    """Rows past the last one of a page."""
    key = decode_cursor(cursor)
    return F.col("sort_key") < key["sort_key"] if key else F.lit(True)


def within(since: str | None, until: str | None) -> Column:
    """String bounds on the sort key, the upper one inclusive by prefix."""
    out = F.lit(True)
    if since:
        out = out & (F.col("sort_key") >= since)
    if until:
        out = out & (F.col("sort_key") <= F.lit(until + "￿"))
    return out


def latest(articles: DataFrame, limit: object = None, kind: str | None = None, cursor: str | None = None, more: int = 0) -> DataFrame:
    """The newest public rows, of one kind if given; `more` rows over the limit."""
    rows = keyed(public(articles)).where(after(cursor))
    if checked_kind(kind):
        rows = rows.where(F.coalesce(F.col("content_kind"), F.lit("news")) == kind)
    return rows.orderBy(F.desc("sort_key")).limit(checked_limit(limit) + more)


def of_companies(articles: DataFrame, names: list[str], kind: str | None = None, since: str | None = None, until: str | None = None, limit: object = None, cursor: str | None = None, more: int = 0) -> DataFrame:
    """The newest public rows of any of the companies; a row under several is kept under the first asked for; `more` rows over the limit."""
    names = [n for n in names if n]
    if not names:
        raise ValueError("at least one company")
    n = checked_limit(limit)
    rows = keyed(public(articles)).where(within(since, until) & after(cursor))
    if checked_kind(kind):
        rows = rows.where(F.coalesce(F.col("content_kind"), F.lit("news")) == kind)
    asked = F.array(*map(F.lit, names))
    rows = rows.withColumn("company", F.get(F.filter(asked, lambda a: F.array_contains(companies(F.col("tag")), a)), 0)).where("company is not null")
    return rows.orderBy(F.desc("sort_key")).limit(n + more)


def store_companies(company_rows: DataFrame, names: list[str], per_company: int, limit: int) -> DataFrame:
    """The store's own merge: the newest of each company, then one row for each hash under the first asked for, newest first."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("company"))
    rows = company_rows.where(F.col("company").isin(names)).withColumn("place", place)
    newest = Window.partitionBy("company").orderBy(F.desc("published_at"), F.desc("article_hash"))
    rows = rows.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= per_company)
    first = Window.partitionBy("article_hash").orderBy("place")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.orderBy(F.desc("published_at"), "place", F.desc("article_hash")).limit(limit).drop("n", "place")


def highlights(articles: DataFrame, latest_n: int = 100, most: int = 8) -> DataFrame:
    """The newest article of each company among the latest; companies by first appearance."""
    rows = latest(articles, latest_n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sort_key"))))  # over latest_n rows
    rows = rows.select("*", F.posexplode(companies(F.col("tag"))).alias("pos", "company"))
    own = Window.partitionBy("company").orderBy("rank", "pos")
    return rows.withColumn("n", F.row_number().over(own)).where("n = 1").orderBy("rank", "pos").limit(most).drop("n")


def load_more(shown: DataFrame, page: DataFrame) -> DataFrame:
    """The page's rows that are not shown already, after those that are."""
    fresh = page.join(shown.select("article_hash").distinct(), "article_hash", "left_anti")
    return shown.withColumn("page", F.lit(0)).unionByName(fresh.withColumn("page", F.lit(1)))


def merged_pages(company_rows: DataFrame, names: list[str], per_company: int, day_from: str, day_to: str) -> DataFrame:
    """The home page's feed: each company's newest, bag union, within days, newest first; no deduplication."""
    newest = Window.partitionBy("company").orderBy(F.desc("published_at"), F.desc("article_hash"))
    rows = company_rows.where(F.col("company").isin(names)).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= per_company)
    return rows.where(F.substring("published_at", 1, 10).between(day_from, day_to)).drop("n")


def newest_per_feed(items: DataFrame, cap: int | None, feed: str = "source", min_date: Column | None = None) -> DataFrame:
    """Filter by date (undated rows stay), sort newest first (undated last, in feed order), then cap. No cap given: two; nought: none."""
    cap = 2 if cap is None else cap
    rows = items if min_date is None else items.where(F.col("published").isNull() | (F.col("published") >= min_date))
    order = Window.partitionBy(feed).orderBy(F.col("published").desc_nulls_last(), "pos")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def feed_funnel(items: DataFrame, cap: int, min_date: Column, feed: str = "source") -> DataFrame:
    inside = F.col("published").isNull() | (F.col("published") >= min_date)
    return items.groupBy(feed).agg(F.count("*").alias("total"), F.count_if(inside).alias("in_window"), F.least(F.count_if(inside), F.lit(cap)).alias("kept"))


def first_per_feed(items: DataFrame, cap: int = 25, feed: str = "source") -> DataFrame:
    """The cap of plain feeds comes first, in feed order."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(feed).orderBy("pos"))).where(F.col("rank") <= cap)


def articles(rows: DataFrame, params: dict[str, str] | None = None, strict: bool = True) -> tuple[DataFrame, str | None]:
    """The read entry point: a page in public shape with its sort_key, and the cursor of the next one (none at the end).

    params: limit (20, at most 100), cursor, company (names with commas between), kind, and with company from and to. Raises
    ValueError for a limit that is no positive integer, a kind that is unknown (without `strict`, as in a proxy, it
    counts as absent) and a company list without names. Pages are exact with several companies, too.
    """
    asked = params or {}
    limit, kind, cursor = checked_limit(asked.get("limit")), asked.get("kind") or None, asked.get("cursor")
    if not strict and kind not in ("news", "social"):
        kind = None
    if asked.get("company"):
        names = [n.strip() for n in asked["company"].split(",") if n.strip()]
        page = of_companies(rows, names, kind, asked.get("from"), asked.get("to"), limit, cursor, 1)
    else:
        page = latest(rows, limit, kind, cursor, 1)
    shaped = public_shape(page, "sort_key")
    found = shaped.orderBy(F.desc("sort_key")).collect()  # a page and one row
    return rows.sparkSession.createDataFrame(found[:limit], shaped.schema), encode_cursor({"sort_key": found[limit - 1].sort_key}) if len(found) > limit else None


def home(rows: DataFrame, names: list[str] | None = None, kind: str | None = None, since: str | None = None, until: str | None = None, cursor: str | None = None, per_page: int = 24) -> dict[str, DataFrame]:
    """The home page: the highlights, and a page of the feed, of the companies and days asked for if any."""
    feed = of_companies(rows, names, kind, since, until, per_page, cursor) if names else latest(rows, per_page, kind, cursor)
    return {"highlights": highlights(rows), "feed": feed}


def company_page(rows: DataFrame, name: str, kind: str | None = None, cursor: str | None = None, per_page: int = 24) -> DataFrame:
    return of_companies(rows, [name], kind, limit=per_page, cursor=cursor)
