"""Posts and quotes out of rendered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.dates import estimated_date, relative_age_days
from tidewire.functions.payloads import best_video, decimal_comma, grouped_count
from tidewire.functions.text import post_title, strip, visible_text

#: Markers and patterns of the rendered page.
POST = r"\n\s*\*\s*\[ \]\(https://www\.linkedin\.com/posts/"
POST_URL = "https://www.linkedin.com/posts/"
IMAGE = r"""<img[^>]+src="(https://media\.licdn\.com/dms/image/[^"]*(?:feedshare|image-shrink)[^"]*)\""""
PRICE = r"(\d{1,4}[.,]\d{2})\s*(EUR|SEK|USD)\s*[+-]\d{1,4}[.,]\d{2}\s*(?:EUR|SEK|USD)\s*([+-]\d{1,3}[.,]\d{2})\s*%"
UPDATES_HEADING, UPDATES_MENTION = r"(?i)\n##  updates", r"(?i)updates"
NEXT_HEADING = r"\n##[^#]"
POST_TIME = r"(?m)^\s*(\d+)\s*([a-zA-Z]+)\s*(Edited)?\s*$"
POST_BODY = r"(?s)Report this post[^\n]*\n(.*)"
POST_MORE = r"…more|`` ``"
REACTIONS = r"\[\s*([\d,]+)\s*\]\([^)]*social-actions-reactions\)"
COMMENTS = r"\[\s*([\d,]+)\s*Comments?\s*\]\([^)]*social-actions-comments\)"
HREF = r'href="([^"]*)"'
MEDIA = r'<img[^>]+>|<video\b[^>]*>|href="[^"]*"'
ACTIVITY = r"-activity-(\d+)"


def updates_section(markdown: Column) -> Column:
    """From the updates heading, or the first mention, to the next heading. Cut at the first places found: a lazy pattern would try each character in turn."""

    def since(mark: str) -> Column:
        after = F.get(F.split(markdown, mark, 2), 1)
        return F.concat(F.regexp_extract(markdown, mark, 0), F.get(F.split(after, NEXT_HEADING, 2), 0))

    return F.coalesce(since(UPDATES_HEADING), since(UPDATES_MENTION), F.when(markdown.isNotNull(), F.lit("")))


def posts(pages: DataFrame, markdown: str, fetched_at: str) -> DataFrame:
    """A row for each post: position, url, text, relative_time, edited, estimated_age_days, estimated_date, reactions, comments."""
    keep = [c for c in pages.columns if c not in (markdown, fetched_at)]
    chunks = F.split(updates_section(F.col(markdown)), POST)  # named once below, and exploded as outer: else it is worked out again for its size, and for a filter before it
    rows = pages.select(*keep, F.col(fetched_at).alias("_at"), F.posexplode_outer(F.slice(chunks, 2, 1 << 30)).alias("pos", "chunk")).where("pos is not null")
    chunk, when = F.col("chunk"), POST_TIME
    age = F.nullif(F.concat(F.regexp_extract(chunk, when, 1), F.regexp_extract(chunk, when, 2)), F.lit(""))
    body = F.when(chunk.contains("Report this post"), F.regexp_extract(chunk, POST_BODY, 1)).otherwise(chunk)
    body = F.get(F.split(body, POST_MORE, 2), 0)
    out = rows.select(
        *keep, "pos", "_at", F.concat(F.lit(POST_URL), F.substring_index(chunk, ")", 1)).alias("url"),
        strip(F.regexp_replace(body, r"\n\s*\*\s*\z", "")).alias("text"), age.alias("relative_time"),
        (F.regexp_extract(chunk, when, 3) != "").alias("edited"), relative_age_days(age).alias("estimated_age_days"),
        grouped_count(F.regexp_extract(chunk, REACTIONS, 1)).alias("reactions"),
        grouped_count(F.regexp_extract(chunk, COMMENTS, 1)).alias("comments"),
    )
    return out.withColumn("estimated_date", F.date_format(estimated_date(F.col("_at"), F.col("estimated_age_days")), "yyyy-MM-dd")).drop("_at")


def recent_posts(found: DataFrame, days: float, cap: int, page: list[str]) -> DataFrame:
    """Posts with a known age within days, the first `cap` of each page."""
    order = Window.partitionBy(*page).orderBy("pos")
    return found.where(F.col("estimated_age_days") <= days).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def stream_of(pages: DataFrame, html: str, page: str, pattern: str) -> DataFrame:
    """page, pos, token, href: what a pattern finds in each page, in order, with the link that stands in it."""
    found = pages.select(page, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))).alias("pos", "token"))
    return found.withColumn("href", F.nullif(F.regexp_extract("token", HREF, 1), F.lit("")))


def under_links(stream: DataFrame, marks: DataFrame, page: str) -> DataFrame:
    """The tokens of a stream that stand after a mark (page, pos, url), each with the url of the last one: an as-of join by place, one running value over the page."""
    tokens_ = stream.select(page, "pos", F.lit(0).alias("_mark"), "token", F.lit(None).cast("string").alias("url"))
    both = tokens_.unionByName(marks.select(page, "pos", F.lit(1).alias("_mark"), F.lit(None).cast("string").alias("token"), "url"))
    order = Window.partitionBy(page).orderBy("pos", "_mark", "url").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("url", F.last("url", ignorenulls=True).over(order)).where("_mark = 0 and url is not null").drop("_mark")


def media(pages: DataFrame, html: str, wanted: DataFrame, page: str) -> DataFrame:
    """page, url, images, videos: what stands between a post's link and the next wanted one.

    wanted: page, url. A link is known by the activity number in it, else whole, and stands where it is first met; a post without one has no media.
    """
    key = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, ACTIVITY, 1), F.lit("")), F.col(c))
    stream = stream_of(pages, html, page, MEDIA)
    asked = wanted.select(page, "url").distinct()
    marks = stream.where("href is not null").withColumn("_key", key("href")).join(asked.withColumn("_key", key("url")), [page, "_key"]).groupBy(page, "url").agg(F.min("pos").alias("pos"))
    tags = stream.where(F.col("token").startswith("<"))
    value = F.when(F.col("token").startswith("<img"), F.regexp_extract("token", IMAGE, 1)).otherwise(F.to_json(best_video(F.col("token"))))
    kind = F.when(F.col("token").startswith("<img"), "image").otherwise("video")
    inside = under_links(tags, marks, page).select(page, "url", "pos", kind.alias("kind"), F.nullif(F.replace(value, F.lit("&amp;"), F.lit("&")), F.lit("")).alias("value")).where("value is not null")
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "value")))), lambda x: x["value"])
    got = inside.groupBy(page, "url").agg(listed("image").alias("images"), listed("video").alias("videos"))
    none = F.array().cast("array<string>")
    return wanted.join(got, [page, "url"], "left").select(page, "url", F.coalesce("images", none).alias("images"), F.coalesce("videos", none).alias("videos"))


def social_items(pages: DataFrame, markdown: str, html: str, fetched_at: str, page: str, days: float = 30.0, cap: int = 10) -> DataFrame:
    """Company pages (page, markdown, html, fetched_at) as feed items: the recent posts of the updates section, each with the media under its link."""
    found = recent_posts(posts(pages.select(page, markdown, fetched_at), markdown, fetched_at), days, cap, [page])
    shown = media(pages.select(page, html), html, found.select(page, "url"), page)
    joined = found.join(shown.dropDuplicates([page, "url"]), [page, "url"])
    return post_item(joined, page, "pos")


def post_item(found: DataFrame, *more: str) -> DataFrame:
    """Posts as feed items; what has no column of its own goes into `extra`. more: further columns that stay."""
    cover = F.coalesce(F.get("images", 0), F.get_json_object(F.get("videos", 0), "$.poster"), F.lit(""))
    return found.select(
        *more, post_title(F.col("text")).alias("title"), F.col("url").alias("link"), F.col("estimated_date").alias("published_at"),
        F.col("text").alias("action_description"), cover.alias("image_url"), F.col("images").alias("image_urls"),
        F.to_json(F.struct("relative_time", "edited", "reactions", "comments", "videos")).alias("extra"),
    )


def quote(page: Column, currency: str) -> Column:
    """struct<price, change_percent> of the first price block in a currency; null if there is none."""
    text = visible_text(page)
    blocks = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(PRICE), F.lit(i)).alias(n) for i, n in ((1, "price"), (2, "currency"), (3, "change"))))
    first = F.get(F.filter(blocks, lambda b: b["currency"] == currency), 0)
    return F.when(first.isNotNull(), F.struct(decimal_comma(first["price"]).alias("price"), decimal_comma(first["change"]).alias("change_percent")))


def blocked_page(result: Column, indicators: list[str], statuses: list[int], min_chars: int) -> Column:
    """Whether a crawl result (success, status, url, html, markdown, error, exception) is a block or a transient failure.

    The markers of exceptions and errors are fixed values.
    """
    text = lambda name: F.lower(F.coalesce(result[name], F.lit("")))
    status, ok = result["status"], F.coalesce(result["success"], F.lit(False))
    fine = status.isNull() | ((status >= 200) & (status < 400))
    short = F.length(strip(text("markdown"))) < min_chars
    hit = F.lit(False)
    for word in indicators:
        hit = hit | text("html").contains(word.lower()) | text("markdown").contains(word.lower())
    errors = text("error").rlike("timeout|net::|err_|connection reset|forbidden")
    without = F.coalesce(status.isin(statuses), F.lit(False)) | (~ok & errors) | (hit & (~ok | (fine & short))) | (ok & short & fine)
    return F.when(result["exception"].isNotNull(), text("exception").rlike("timeout|net::|err_|connection reset|connection aborted|temporarily|forbidden")).otherwise(without)


def blocked_social(result: Column) -> Column:
    bad = F.coalesce(result["status"].isin(999, 429), F.lit(False)) | F.coalesce(result["url"].rlike("authwall|/login"), F.lit(False))
    return ~F.coalesce(result["success"], F.lit(False)) | bad | F.coalesce(result["markdown"].contains("linkedin.com/authwall"), F.lit(False))


def company_page(slug: Column) -> Column:
    path = F.when(slug.startswith("showcase/"), slug).otherwise(F.concat(F.lit("company/"), slug))
    return F.concat(F.lit("https://www.linkedin.com/"), path, F.lit("/"))
