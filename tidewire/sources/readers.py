"""Catalogs, RSS bodies, raw Markdown and quote payloads as rows.

Nothing here calls out: bodies come from a table or from a callable that is passed in.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.payloads import backoff_seconds, verdict
from tidewire.functions.social import company_page
from tidewire.functions.text import collapse, nz, search_url, strip, strip_html, truncated

SOURCE = "source_id string, name string, source_type string, tag string, product_line string, category string, feed_type string, rss_url string, query_text string, active boolean, content_kind string"
SOURCE_DEFAULTS = {"source_type": "concorrente", "product_line": "Geral", "category": "auto", "active": True}
#: The news search feed.
SEARCH, LOCALE = "https://news.google.com/rss/search?q=", "&hl=pt-BR&gl=BR&ceid=BR:pt-419"


def catalog(spark: SparkSession, text: str | None) -> DataFrame:
    """Sources of a YAML text; an RSS URL makes a source rss_direct, and a social feed a social kind."""
    import yaml

    rows = []
    for x in (yaml.safe_load(text or "") or {}).get("sources") or []:
        rows.append(tuple(x.get(n.split()[0]) for n in SOURCE.split(", ")))
    return with_defaults(spark.createDataFrame(rows, SOURCE))


def with_defaults(sources: DataFrame) -> DataFrame:
    """Sources with what their catalog leaves open; a column that is missing is open in every row."""
    given = {n: F.col(n).cast(kind) if n in sources.columns else F.lit(None).cast(kind) for n, kind in (x.split() for x in SOURCE.split(", "))}
    rows = sources.select(*(c.alias(n) for n, c in given.items()))
    rows = rows.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in SOURCE_DEFAULTS.items()})
    rows = rows.withColumn("feed_type", F.when(nz(F.col("rss_url")).isNotNull(), "rss_direct").otherwise(F.coalesce(nz(F.col("feed_type")), F.lit("google_news_query"))))
    kind = F.when(F.col("feed_type") == "linkedin_company", "social").otherwise("news")
    return rows.withColumns({"content_kind": F.coalesce(nz(F.col("content_kind")), kind), "source_id": F.coalesce(nz(F.col("source_id")), F.col("name"))})


def feed_url(sources: DataFrame) -> Column:
    """The URL that a source is read from: social page, own feed, else a search for its query, tag or name."""
    query = F.coalesce(nz(sources["query_text"]), nz(sources["tag"]), sources["name"])
    return F.when(sources["feed_type"] == "linkedin_company", company_page(sources["query_text"])).when((sources["feed_type"] == "rss_direct") & nz(sources["rss_url"]).isNotNull(), sources["rss_url"]).otherwise(search_url(SEARCH, query, LOCALE))


_MEDIA = "`media:content`:array<struct<_url:string,_type:string>>,`media:thumbnail`:array<struct<_url:string>>"
ITEM = f"struct<title:string,link:string,pubDate:string,updated:string,source:string,description:string,enclosure:array<struct<_url:string,_type:string>>,{_MEDIA}>"
ENTRY = f"struct<title:string,link:array<struct<_href:string,_rel:string,_type:string>>,published:string,updated:string,summary:string,content:string,{_MEDIA}>"


def rss_date(c: Column) -> Column:
    """RFC 822 or ISO as a UTC instant; the day's name is left out, which Spark doesn't parse."""
    bare = F.regexp_replace(strip(c), r"^\w{3}, ", "")
    zoned = F.regexp_replace(bare, r" (GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare))


def _urls(links: Column, url: str = "_url", kind: str | None = "_type") -> Column:
    return F.transform(links, lambda m: F.struct(m[url].alias("url"), (m[kind] if kind else F.lit(None).cast("string")).alias("type")))


def _entries(feed: Column) -> Column:
    """RSS items, else Atom entries, in one shape."""

    def one(title: Column, link: Column, date: Column, source: Column, text: Column, closed: Column, x: Column) -> Column:
        image = entry_image(_urls(x["media:content"]), _urls(x["media:thumbnail"], kind=None), closed)
        return F.struct(title.alias("title"), link.alias("link"), date.alias("date"), source.alias("source"), text.alias("text"), image.alias("image"))

    def item(x: Column) -> Column:
        return one(x["title"], x["link"], F.coalesce(nz(x["pubDate"]), x["updated"]), x["source"], x["description"], _urls(x["enclosure"]), x)

    def entry(x: Column) -> Column:
        own = F.get(F.filter(x["link"], lambda m: F.coalesce(m["_rel"], F.lit("alternate")) == "alternate"), 0)["_href"]
        closed = _urls(F.filter(x["link"], lambda m: m["_rel"] == "enclosure"), "_href")
        return one(x["title"], own, F.coalesce(nz(x["published"]), x["updated"]), F.lit(None).cast("string"), F.coalesce(nz(x["summary"]), x["content"]), closed, x)

    return F.coalesce(F.transform(feed["channel"]["item"], item), F.transform(feed["entry"], entry))


def rss_items(bodies: DataFrame, body: str = "body") -> DataFrame:
    """A row for each RSS or Atom entry with a title and a link, in feed order: pos, title, link, published, publisher, summary_text, image_url."""
    keep = [c for c in bodies.columns if c != body]
    feed = F.from_xml(F.col(body), f"struct<channel:struct<item:array<{ITEM}>>,entry:array<{ENTRY}>>")
    rows = bodies.select(*keep, feed.alias("_feed")).select(*keep, F.posexplode(_entries(F.col("_feed"))).alias("pos", "x"))
    rows = rows.where(nz(F.col("x.title")).isNotNull() & nz(F.col("x.link")).isNotNull())
    title, tail = F.col("x.title"), F.trim(F.substring_index(F.col("x.title"), " - ", -1))
    return rows.select(
        *keep, "pos", strip_html(title).alias("title"), strip(F.col("x.link")).alias("link"), rss_date(F.col("x.date")).alias("published"),
        F.coalesce(nz(strip(F.col("x.source"))), F.when(title.contains(" - "), tail), F.lit("")).alias("publisher"),
        strip_html(F.coalesce(F.col("x.text"), F.lit(""))).alias("summary_text"), F.col("x.image").alias("image_url"),
    )


def entry_image(media: Column, thumbnails: Column, enclosures: Column) -> Column:
    """The first image of an entry's media, else its first thumbnail, else an image enclosure."""
    picture = F.get(F.filter(media, lambda m: nz(m["url"]).isNotNull() & F.coalesce(m["type"], F.lit("image")).rlike("^$|image")), 0)["url"]
    thumb = F.get(F.filter(thumbnails, lambda m: nz(m["url"]).isNotNull()), 0)["url"]
    closed = F.get(F.filter(enclosures, lambda m: nz(m["url"]).isNotNull() & m["type"].contains("image")), 0)["url"]
    return F.coalesce(picture, thumb, closed, F.lit(""))


def raw_markdown(texts: DataFrame, text: str = "value", limit: int = 2000) -> DataFrame:
    """title, url, excerpt of raw Markdown: the first heading, the first URL line, and what follows the later of the two."""
    c = F.col(text)
    body = F.regexp_replace(c, r"(?s)^(?:(?!\nURL:).)*\nURL:[^\n]*\n?", "")
    after = F.when(c.rlike(r"(?m)^URL:"), body).otherwise(F.regexp_replace(c, r"(?s)^\s*#\s[^\n]*\n?", ""))
    return texts.select("*", nz(F.regexp_extract(c, r"(?m)^#\s+(.+?)\s*$", 1)).alias("title"), nz(F.regexp_extract(c, r"(?m)^URL:\s*(\S+)", 1)).alias("url"), F.substring(strip(after), 1, limit).alias("excerpt"))


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Raw Markdown files in name order: slug, value and what raw_markdown finds."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return raw_markdown(files.withColumn("slug", F.regexp_extract("_metadata.file_name", r"(.*)\.md$", 1)))


def quotes(payloads: DataFrame, wanted: DataFrame, payload: str = "payload") -> DataFrame:
    """symbol, company, price, change_percent of a batch quote payload: keyed by symbol, or bare for a single one.

    wanted: symbol, company. Errors, unknown symbols and prices that are no numbers are dropped.
    """
    one = "struct<symbol:string,close:string,percent_change:string,currency:string,status:string>"
    many = F.from_json(payload, f"map<string,{one}>")
    single = F.from_json(payload, one)
    rows = payloads.select(F.explode(F.when(single["symbol"].isNotNull(), F.create_map(single["symbol"], single)).otherwise(many)).alias("symbol", "q"))
    rows = rows.where(~F.col("q.status").eqNullSafe("error"))
    out = rows.join(wanted, "symbol").select("symbol", "company", F.col("q.close").try_cast("double").alias("price"), F.col("q.percent_change").try_cast("double").alias("change_percent"))
    return out.where(F.col("price").isNotNull() & F.col("change_percent").isNotNull() & ~F.isnan("price"))


def snapshot_quotes(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows of an {"items": [...]} snapshot whose company and numbers have the right types; the company is the symbol."""
    items = F.from_json(payload, "struct<items:array<struct<company:string,price:double,change_percent:double,currency:string>>>")["items"]
    return payloads.select(F.explode(items).alias("q")).where("q.company is not null and q.price is not null and q.change_percent is not null").select(F.col("q.company").alias("symbol"), "q.company", "q.price", "q.change_percent")


def fetched(urls: DataFrame, fetch: Callable[[str], str], url: str = "url") -> DataFrame:
    """url, body, error of each distinct URL by a callable; one URL's failure is its own row's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for u in batch["url"]:
                try:
                    rows.append((u, fetch(u), None))
                except Exception as e:  # noqa: BLE001  a source's failure is data
                    rows.append((u, None, str(e)[:120]))
            yield pd.DataFrame(rows, columns=["url", "body", "error"])

    return urls.select(F.col(url).alias("url")).distinct().mapInPandas(run, "url string, body string, error string")


def fetched_politely(urls: DataFrame, fetch: Callable[[str], str], url: str = "url", lanes: int = 2, delay: float = 0.25, jitter: float = 0.25) -> DataFrame:
    """As fetched, but a host's URLs are dealt into at most `lanes` (nought: one) tasks, so many requests are under way at once; each task spaces its requests to one host by the delay and a random part of the jitter."""
    lanes = max(lanes, 1)
    host = F.lower(F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit("")))
    rows = urls.select(F.col(url).alias("url")).distinct().select("url", host.alias("host"), F.pmod(F.xxhash64("url"), F.lit(lanes)).alias("lane"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for batch in batches:
            out = []
            for u, h in zip(batch["url"], batch["host"], strict=True):
                wait = last.get(h, 0.0) + (delay * lanes + random.uniform(0, jitter)) - time.monotonic() if h in last else 0.0
                if wait > 0:
                    time.sleep(wait)
                last[h] = time.monotonic()
                try:
                    out.append((u, fetch(u), None))
                except Exception as e:  # noqa: BLE001  a source's failure is data
                    out.append((u, None, str(e)[:120]))
            yield pd.DataFrame(out, columns=["url", "body", "error"])

    return rows.repartition("host", "lane").sortWithinPartitions("host", "url").mapInPandas(run, "url string, body string, error string")


def resolved(links: DataFrame, resolve: Callable[[str], str], link: str = "link") -> DataFrame:
    """Rows with resolved_link, resolve_status (ok, skipped, failed) and resolve_error: only wrapper links are resolved, each once; one that stays a wrapper failed."""
    wrapper = F.col(link).contains("news.google")
    answers = fetched(links.where(wrapper), resolve, link).select(F.col("url").alias("_u"), "body", "error")
    out = links.join(answers, F.col(link) == F.col("_u"), "left")
    bad = F.col("body").isNull() | F.col("body").contains("news.google")
    return out.select(*links.columns, F.when(~wrapper, F.col(link)).when(~bad, F.col("body")).alias("resolved_link"), F.when(~wrapper, "skipped").when(bad, "failed").otherwise("ok").alias("resolve_status"), F.when(wrapper & bad, F.coalesce("error", F.lit("still a wrapper link"))).alias("resolve_error"))


def summary_prompt(title: Column, content: Column, limit: int = 20_000) -> Column:
    """What a model is asked: the title and the content, which is cut beyond the limit."""
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\n\nContent:\n"), truncated(F.coalesce(content, F.lit("")), limit))


def summarized(articles: DataFrame, summarize: Callable[[str], str], text: str = "content", attempts: int = 3, again: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), base: float = 1.0) -> DataFrame:
    """article_hash, raw, error by a callable from a prompt's text to a model's answer, or to the answer and its finish reason; failures are data, empty answers fail and tell the reason.

    A failure of a kind in `again` is tried anew, up to `attempts` times in all, after base, 2 base, ... seconds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, t in zip(batch["article_hash"], batch["t"], strict=True):
                for k in range(attempts):
                    try:
                        said = summarize(t)
                        answer, why = (said[0], f"empty response (finish_reason={said[1] or 'unknown'})") if isinstance(said, tuple) else (said, "empty answer")
                        answer = answer if (answer or "").strip() else None
                        row = (h, answer, None if answer else why)
                        break
                    except again as e:
                        row = (h, None, str(e)[:200])
                        if k + 1 < attempts:
                            time.sleep(backoff_seconds(k, base))
                    except Exception as e:  # noqa: BLE001
                        row = (h, None, str(e)[:200])
                        break
                rows.append(row)
            yield pd.DataFrame(rows, columns=["article_hash", "raw", "error"])

    return articles.select("article_hash", F.col(text).alias("t")).mapInPandas(run, "article_hash string, raw string, error string")


def embedded(items: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """rowid, embedding by a callable over batches of texts: the title, a blank line and 2,000 characters of the excerpt. As many vectors as texts must come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                some = rows.iloc[at : at + batch]
                vectors = embed(list(some["t"]))
                if len(vectors) != len(some):
                    raise ValueError(f"{len(some)} texts gave {len(vectors)} vectors")
                yield pd.DataFrame({"rowid": some["rowid"].to_numpy(), "embedding": list(vectors)})

    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.substring(F.coalesce("excerpt", F.lit("")), 1, 2000))
    return items.select("rowid", text.alias("t")).mapInPandas(run, "rowid long, embedding array<double>")


def judge_prompt(title_a: Column, excerpt_a: Column, title_b: Column, excerpt_b: Column) -> Column:
    def item(name: str, title: Column, excerpt: Column) -> Column:
        return F.concat(F.lit(f"Item {name} title: "), title, F.lit(f"\nItem {name} excerpt: "), F.substring(F.coalesce(nz(excerpt), title), 1, 400))

    return F.concat(item("A", title_a, excerpt_a), F.lit("\n\n"), item("B", title_b, excerpt_b), F.lit("\n\nRespond with exactly one of: same, different, related."))


def judged(pairs: DataFrame, items: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """Those (a, b) that a model calls the same; what fails is different. items: rowid, title, excerpt."""
    sides = [items.select(F.col("rowid").alias(n), F.coalesce("title", F.lit("")).alias(f"title_{n}"), F.col("excerpt").alias(f"excerpt_{n}")) for n in "ab"]
    asked = pairs.select("a", "b").distinct().join(sides[0], "a").join(sides[1], "b")
    asked = asked.select(F.concat_ws(" ", "a", "b").alias("article_hash"), "a", "b", judge_prompt(*(F.col(f"{c}_{n}") for n in "ab" for c in ("title", "excerpt"))).alias("content"))
    said = summarized(asked, ask, attempts=1).where(verdict(F.col("raw")) == "same")
    ids = F.split("article_hash", " ")
    return said.select(ids[0].cast("long").alias("a"), ids[1].cast("long").alias("b"))


def probed(active: DataFrame, bodies: DataFrame) -> DataFrame:
    """source_id, n: entries of each active source's body; -1 if it failed, -3 for social ones, which are skipped."""
    counts = rss_items(bodies.where("error is null")).groupBy("source_id").agg(F.count("*").alias("n"))
    out = active.join(counts, "source_id", "left").join(bodies.select("source_id", "error"), "source_id", "left")
    n = F.when(F.col("feed_type") == "linkedin_company", -3).when(F.col("error").isNotNull(), -1).otherwise(F.coalesce("n", F.lit(0)))
    return out.select("source_id", n.cast("long").alias("n"), "error")


def title_of(page: Column) -> Column:
    return strip_html(collapse(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def in_scope(sources: DataFrame, companies: list[str]) -> DataFrame:
    """Sources whose tag is one of the companies; all of them if none is named."""
    return sources.where(F.col("tag").isin(companies)) if companies else sources
