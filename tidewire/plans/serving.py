"""Further queries: the read entry point and pages, run reports, what readers keep, targets, upkeep, and single expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import dates, payloads, social, text
from tidewire.operators import cascade, feed, runs, saved, store
from tidewire.plans import views
from tidewire.plans.catalog import A, FD, FE, I, _CATALOG, _TAGGED, _TWO, query
from tidewire.sources import readers, targets, writers
from tidewire.streaming import jobs

# The read API and pages -----------------------------------------------------------------------------


@query(f"WITH {A} SELECT article_hash, title, source_name, sort_key FROM pub WHERE coalesce(content_kind, 'news') = 'social' ORDER BY sort_key DESC LIMIT 30")
def api_articles(spark, sf):
    page, _ = feed.articles(views.articles(spark, sf), {"limit": "30", "kind": "social"})
    return page.select("article_hash", "title", "source_name", "sort_key")


@query(f"WITH {A} SELECT article_hash, sort_key FROM pub ORDER BY sort_key DESC LIMIT 20")
def api_proxy(spark, sf):
    """An unknown kind counts as absent."""
    page, _ = feed.articles(views.articles(spark, sf), {"kind": "podcast"}, strict=False)
    return page.select("article_hash", "sort_key")


@query(f"WITH {A} SELECT article_hash, sort_key FROM (SELECT article_hash, sort_key, row_number() OVER (ORDER BY sort_key DESC) AS n FROM (SELECT *, {_TWO} AS company FROM pub) WHERE company IS NOT NULL) WHERE n > 20 AND n <= 40")
def pag_multi(spark, sf):
    """The second page of two companies, by the first one's cursor."""
    rows, asked = views.articles(spark, sf), {"company": "src0, src1"}
    _, cursor = feed.articles(rows, asked)
    page, _ = feed.articles(rows, asked | {"cursor": cursor})
    return page.select("article_hash", "sort_key")


@query(f"WITH {A} SELECT coalesce(summary_status, 'pending') AS summary_status, title, source_name FROM articles WHERE article_hash = md5('7')")
def api_article(spark, sf):
    return store.by_hash(views.articles(spark, sf), "8f14e45fceea167a5a36dedd4bea2543").select("summary_status", "title", "source_name")


@query(f"""WITH {A}, top AS (SELECT *, row_number() OVER (ORDER BY sort_key DESC) AS rank FROM pub ORDER BY sort_key DESC LIMIT 100),
firms AS (SELECT article_hash, rank, generate_subscripts(f, 1) AS pos, unnest(f) AS company FROM (SELECT article_hash, rank, list_filter(list_transform(string_split(tag, ','), lambda x: trim(x)), lambda x: x <> '') AS f FROM top)),
own AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY rank, pos) AS n FROM firms),
high AS (SELECT article_hash FROM own WHERE n = 1 ORDER BY rank, pos LIMIT 8)
SELECT 'highlights' AS section, article_hash FROM high UNION ALL SELECT 'feed', article_hash FROM top WHERE rank <= 24""")
def page_home(spark, sf):
    parts = feed.home(views.articles(spark, sf))
    one = [rows.select(F.lit(name).alias("section"), "article_hash") for name, rows in parts.items()]
    return one[0].union(one[1])


@query(f"WITH {A} SELECT article_hash, sort_key FROM pub WHERE {_TAGGED.format('src3')} ORDER BY sort_key DESC LIMIT 24")
def page_company(spark, sf):
    return feed.company_page(views.articles(spark, sf), "src3").select("article_hash", "sort_key")


# Reports --------------------------------------------------------------------------------------------

_RUNS = """runs AS (SELECT CAST(user_id AS VARCHAR) AS source, CASE user_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'raised' ELSE 'ok' END AS status, count(*) AS found,
count(*) FILTER (event_type = 'view') AS "new", count(*) FILTER (event_type <> 'view') AS duplicate, 'HTTP ' || (400 + user_id % 100) AS error FROM events GROUP BY user_id)"""


def _runs(spark, sf):
    e = views.read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("found"), F.count_if(F.col("event_type") == "view").alias("new"), F.count_if(F.col("event_type") != "view").alias("duplicate"))
    return e.selectExpr("cast(user_id as string) source", "case user_id % 5 when 0 then 'error' when 1 then 'raised' else 'ok' end status", "found", "new", "duplicate", "concat('HTTP ', 400 + user_id % 100) error")


@query(f"""WITH {_RUNS} SELECT CAST(sum(found) FILTER (status = 'ok') AS BIGINT) AS found, CAST(sum("new") FILTER (status = 'ok') AS BIGINT) AS "new", CAST(sum(duplicate) FILTER (status = 'ok') AS BIGINT) AS duplicate,
count(*) FILTER (status = 'ok') AS sources_ok, count(*) FILTER (status <> 'ok') AS sources_error FROM runs""")
def agg_collect(spark, sf):
    return runs.collect_totals(_runs(spark, sf))


@query(f"WITH {_RUNS} SELECT source, error FROM runs WHERE status = 'error'")
def agg_collect_errors(spark, sf):
    return runs.collect_errors(_runs(spark, sf))


@query("SELECT count(*) FILTER (NOT (quality = 0) AND toxic = 0) AS summarized, count(*) FILTER (NOT (quality = 0) AND toxic = 1) AS irrelevant, count(*) FILTER (quality = 0) AS failed FROM labels")
def agg_sum_summary(spark, sf):
    return runs.summary_totals(views.read(spark, sf, "labels").selectExpr("toxic = 0 as relevant", "case when quality = 0 then 'empty answer' end as error"))


@query("""SELECT event_type AS stage, '  [' || CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'OK' END || '] ' || event_type || ' (' || CAST(max(event_id) - min(event_id) AS VARCHAR) || '.5s)'
|| chr(10) || '         rows: ' || count(*) || chr(10) || '         users: ' || count(DISTINCT user_id) AS text FROM events GROUP BY event_type""")
def agg_metrics(spark, sf):
    e = views.read(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.min("event_id").cast("double").alias("started_at"), (F.max("event_id") + 0.5).cast("double").alias("ended_at"), F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))
    rows = e.withColumns({"success": F.col("stage") != "error", "details": F.expr("map('users', cast(u as string), 'rows', cast(n as string))")})
    return runs.stage_lines(rows).select("stage", "text")


@query(f"""WITH {A}, seen AS (SELECT * FROM articles WHERE summary_status IS DISTINCT FROM 'irrelevant')
SELECT 'sources' AS section, 'active' AS name, 3 AS n UNION ALL SELECT 'articles', 'visible', count(*) FROM seen
UNION ALL SELECT 'status', coalesce(summary_status, ''), count(*) FROM articles GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM seen GROUP BY 2""")
def cli_status(spark, sf):
    return runs.store_state(views.articles(spark, sf), readers.catalog(spark, _CATALOG))


# What readers keep ----------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, CAST(event_id % 40 AS VARCHAR) AS article_hash, event_id AS "at", event_type FROM events),
saved AS (SELECT user_id, article_hash, max("at") AS "at" FROM e WHERE event_type = 'view' GROUP BY 1, 2),
clears AS (SELECT user_id, min("at") AS cleared FROM e WHERE event_type = 'error' GROUP BY 1),
alls AS (SELECT * FROM saved UNION ALL SELECT user_id, article_hash, "at" FROM e WHERE event_type <> 'view')
SELECT a.user_id, article_hash, max("at") AS "at" FROM alls a LEFT JOIN clears c ON a.user_id = c.user_id WHERE cleared IS NULL OR "at" > cleared GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def set_toggle(spark, sf):
    e = views.read(spark, sf, "events").selectExpr("user_id", "cast(event_id % 40 as string) article_hash", "event_id at", "event_type")
    kept = e.where("event_type = 'view'").groupBy("user_id", "article_hash").agg(F.max("at").alias("at"))
    clears = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("at").alias("at"))
    return saved.toggled(kept, e.where("event_type <> 'view'"), clears)


@query(f"WITH {A} SELECT article_hash FROM articles WHERE article_hash IN (SELECT md5(CAST(doc_id AS VARCHAR)) FROM labels WHERE quality = 1)")
def jn_bookmark(spark, sf):
    kept = views.read(spark, sf, "labels").where("quality = 1").selectExpr("md5(cast(doc_id as string)) article_hash")
    return saved.bookmarked(views.articles(spark, sf), kept).select("article_hash")


@query(f"""WITH {A}, l AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS article_hash, doc_id, quality, toxic FROM labels)
SELECT a.article_hash, CASE WHEN toxic = 1 THEN 'held ' || l.doc_id WHEN quality = 1 THEN 'kept ' || l.doc_id END AS title, CASE WHEN toxic = 1 THEN 'cache' WHEN quality = 1 THEN 'bookmark' END AS origin FROM articles a LEFT JOIN l ON a.article_hash = l.article_hash""")
def jn_detail(spark, sf):
    l = views.read(spark, sf, "labels")
    held, kept = (l.where(f"{c} = 1").selectExpr("md5(cast(doc_id as string)) article_hash", f"concat('{w} ', doc_id) title") for c, w in (("toxic", "held"), ("quality", "kept")))
    return saved.detail(views.articles(spark, sf), held, kept)


@query()
def lim_cache50(spark, sf):
    """Each user's cache of recent articles; held against a plain cache in the tests."""
    return saved.recent(views.read(spark, sf, "events").selectExpr("user_id session", "cast(event_id * 7 % 131 as string) article_hash", "event_id at"), 20)


@query("SELECT s_name AS company, s_acctbal AS price, NULL AS currency FROM supplier UNION ALL SELECT c_name, c_acctbal, 'EUR' FROM customer")
def set_union_quotes(spark, sf):
    own = views.read(spark, sf, "supplier").selectExpr("s_name company", "s_acctbal price")
    return saved.all_quotes(own, views.read(spark, sf, "customer").selectExpr("c_name company", "c_acctbal price", "'EUR' currency"))


@query(f"WITH {A} SELECT DISTINCT company FROM company")
def set_company_list(spark, sf):
    return saved.company_list(store.company_rows(views.articles(spark, sf)))


@query(f"WITH {FD}, u AS (SELECT source, 'news' AS content_kind FROM feed UNION ALL SELECT role, 'social' FROM conversations) SELECT source, content_kind, count(*) AS found FROM u GROUP BY 1, 2")
def set_union_sources(spark, sf):
    """The news pass and the social pass as one collection, counted by source."""
    news = views.feed_items(spark, sf).select("source", F.lit("news").alias("content_kind"))
    posts = views.read(spark, sf, "conversations").select(F.col("role").alias("source"), F.lit("social").alias("content_kind"))
    return saved.all_quotes(news, posts).groupBy("source", "content_kind").agg(F.count("*").alias("found"))


# Targets, sources and upkeep ------------------------------------------------------------------------

@query("""SELECT 'p' || page_id AS slug, CASE WHEN strpos(url, '1') = 0 THEN '# p' || page_id || E'\\n\\nURL: ' || url || E'\\n\\nBODY OF ' || upper(url) END AS content,
CASE WHEN strpos(url, '1') > 0 THEN 'empty markdown' END AS error FROM pages""")
def src_crawl_targets(spark, sf):
    """A stand-in for the browser: pages with a 1 in their URL come back empty."""
    rows = views.read(spark, sf, "pages").selectExpr("concat('p', page_id) slug", "url", "cast(null as string) title")
    return targets.crawled(rows, lambda u: "" if "1" in u else f"\nBODY OF {u.upper()} ")


@query("SELECT event_id, 'https://i.example/' || CASE event_id % 4 WHEN 0 THEN 'm' WHEN 1 THEN 't' WHEN 2 THEN 'e' END || '.png' AS i FROM events".replace("AS i", "AS image_url").replace("SELECT event_id, ", "SELECT event_id, coalesce(").replace("'.png' AS", "'.png', '') AS"))
def src_feed_image(spark, sf):
    parts = {"media": "case when event_id % 4 = 0 then '<m:content url=\"https://i.example/v.mp4\" type=\"video/mp4\"/><m:content url=\"https://i.example/m.png\"/>' else '' end", "thumb": "case when event_id % 4 < 2 then '<m:thumbnail url=\"https://i.example/t.png\"/>' else '' end", "closed": "case when event_id % 4 < 3 then '<enclosure url=\"https://i.example/e.png\" type=\"image/png\"/>' else '<enclosure url=\"https://i.example/e.mp3\" type=\"audio/mpeg\"/>' end"}
    inner = ", ".join(p.replace("m:", "media:") for p in parts.values())
    body = F.expr(f"concat('<rss xmlns:media=\"http://search.yahoo.com/mrss/\"><channel><item><title>t</title><link>l</link>', {inner}, '</item></channel></rss>')")
    return readers.rss_items(views.read(spark, sf, "events").select("event_id", body.alias("body"))).select("event_id", "image_url")


@query("SELECT event_id, 'Entry ' || event_id AS title, 'https://a.example/' || event_id AS link, 'text ' || event_id AS summary_text, '2024-03-0' || (1 + event_id % 9) || ' 05:06:07' AS published FROM events")
def src_atom(spark, sf):
    body = F.expr("""concat('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="html">Entry ', event_id, '</title><link rel="self" href="https://s.example/"/><link href="https://a.example/', event_id, '"/><updated>2024-03-0', 1 + event_id % 9, 'T05:06:07Z</updated><summary>&lt;p&gt;text ', event_id, '&lt;/p&gt;</summary></entry><entry><title>no link</title></entry></feed>')""")
    rows = readers.rss_items(views.read(spark, sf, "events").select("event_id", body.alias("body")))
    return rows.select("event_id", "title", "link", "summary_text", F.date_format(F.to_utc_timestamp("published", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("""SELECT doc_id, 'Title ' || doc_id AS title, 'https://x.example/' || doc_id AS url, left(trim(text, E' \\n\\t\\r\\f\\x0b'), 2000) AS excerpt FROM documents""")
def src_raw_md(spark, sf):
    value = F.expr(r"concat('# Title ', doc_id, '\n\nURL: https://x.example/', doc_id, '\n\n', text)")
    return readers.raw_markdown(views.read(spark, sf, "documents").select("doc_id", value.alias("value"))).select("doc_id", "title", "url", "excerpt")


@query("SELECT event_id, 'C' || event_id % 9 AS symbol, CAST(event_id % 50 AS DOUBLE) + 0.5 AS price, CAST(-1.25 AS DOUBLE) AS change_percent FROM events")
def src_stocks_eu(spark, sf):
    body = F.expr("""concat('{"items": [{"company": "C', event_id % 9, '", "price": ', event_id % 50, '.5, "change_percent": -1.25, "currency": "EUR"}, {"company": "bad"}]}')""")
    rows = views.read(spark, sf, "events").select("event_id", body.alias("payload"))
    found = readers.snapshot_quotes(rows.select("payload").distinct())
    own = rows.selectExpr("event_id", "concat('C', event_id % 9) symbol", "event_id % 50 + 0.5D price")
    return own.join(found, ["symbol", "price"]).select("event_id", "symbol", "price", "change_percent")


@query(f"WITH {A} SELECT article_hash, CAST(row_number() OVER (ORDER BY collected_at, article_hash) + 1000 AS BIGINT) AS rowid FROM articles")
def snk_item(spark, sf):
    return store.numbered(views.articles(spark, sf).select("article_hash", "collected_at"), ["collected_at", "article_hash"], 1000).select("article_hash", F.col("rowid").cast("long").alias("rowid"))


@query(f"WITH {A} SELECT article_hash, '# Summary: ' || title || E'\\nURL: ' || link || E'\\n\\n' || action_description AS content FROM articles")
def snk_summary_md(spark, sf):
    rows = views.articles(spark, sf).selectExpr("article_hash slug", "title", "link url", "action_description summary")
    return writers.summary_markdown(rows.fillna("")).select(F.col("slug").alias("article_hash"), "content")


@query(f"WITH {A} SELECT article_hash, CASE WHEN source_id = 'src1' THEN 'linkedin_company' WHEN source_id = 'src2' THEN 'google_news_query' ELSE 'rss_direct' END AS feed_type, CASE WHEN source_id = 'src1' THEN 'social' ELSE 'news' END AS content_kind FROM articles")
def jn_feed_denorm(spark, sf):
    rows = views.articles(spark, sf)
    sources = rows.select("source_id").distinct().where("source_id <> 'src2'").selectExpr("source_id", "case when source_id = 'src1' then 'linkedin_company' else 'rss_direct' end feed_type", "case when source_id = 'src1' then 'social' else 'news' end content_kind")
    return store.with_feed(rows, sources).select("article_hash", "feed_type", "content_kind")


@query("""WITH f AS (SELECT 'f' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS slug, CASE WHEN doc_id % 3 > 0 THEN 'Title ' || doc_id END AS title, CASE WHEN doc_id % 5 > 0 THEN 'https://x.example/' || doc_id END AS url FROM documents)
SELECT slug, CAST(row_number() OVER (ORDER BY slug) AS BIGINT) AS rowid, md5(coalesce(url, 'local://' || slug)) AS id_hash, md5(lower(coalesce(title, slug))) AS title_hash FROM f""")
def dd5_run(spark, sf):
    """Raw files in name order as rows of the cascade."""
    value = F.expr(r"concat(case when doc_id % 3 > 0 then concat('# Title ', doc_id, '\n\n') else 'no heading\n' end, case when doc_id % 5 > 0 then concat('URL: https://x.example/', doc_id, '\n\n') else '' end)")
    docs = views.read(spark, sf, "documents").select(F.expr("concat('f', lpad(doc_id, 9, '0'))").alias("slug"), value.alias("value"))
    rows = cascade.items_of(readers.raw_markdown(docs), 1704067200.0)
    return rows.select("slug", F.col("rowid").cast("long").alias("rowid"), "id_hash", "title_hash")


# Streams --------------------------------------------------------------------------------------------


@query(f"""WITH {FE}, n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY "at", id) AS n FROM fetches)
SELECT host, id, max("at" - n * 128.0) OVER (PARTITION BY host ORDER BY "at", id ROWS UNBOUNDED PRECEDING) + n * 128.0 AS start FROM n""")
def st_ratelimit(spark, sf):
    return jobs.spaced(views.fetches(spark, sf), 128.0).select("host", "id", "start")


@query(f"""WITH {I}, m AS (SELECT *, created_at >= 1704067200 + 6 * 3600 AS late FROM items),
old AS (SELECT title_hash, arg_max(rowid, created_at) AS old FROM m WHERE NOT late AND status = 'new' AND created_at >= 1704067200 + 3 * 3600 GROUP BY 1),
f AS (SELECT title_hash, min(rowid) AS first FROM m WHERE late GROUP BY 1)
SELECT b.rowid, coalesce(o.old, CASE WHEN f.first < b.rowid THEN f.first END) AS match, CASE WHEN o.old IS NULL AND f.first = b.rowid THEN 'new' ELSE 'dupe' END AS status FROM m b LEFT JOIN old o ON b.title_hash = o.title_hash JOIN f ON b.title_hash = f.title_hash WHERE late""")
def st_window_dedup(spark, sf):
    """The items after six hours as one batch against the store of the three hours before."""
    rows = views.items(spark, sf)
    now = 1704067200 + 6 * 3600
    return jobs.within_window(rows.where(f"created_at >= {now}").select("rowid", "title_hash"), rows.where(f"created_at < {now}"), now, 3).select("rowid", "status", "match")


# Expressions ----------------------------------------------------------------------------------------


def _cleaned(c: str) -> str:
    for pattern, to in ((r"\[#[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"#\S+", ""), (r"https?://\S+", ""), (r"[ \t]+", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"nullif(trim({c}, E' \\n\\t\\r'), '')"


@query(f"WITH {A} SELECT doc_id, coalesce({_cleaned('title')}, {_cleaned('action_description')}, '') AS shown FROM articles")
def fn_display_text(spark, sf):
    return views.articles(spark, sf).select("doc_id", text.display_text(F.lit(""), F.col("title"), F.col("action_description")).alias("shown"))


@query("""SELECT page_id, regexp_extract(regexp_extract(h, '(?i)<meta\\b[^>]*\\bproperty=["'']og:image["''][^>]*>'), '(?i)\\bcontent=["'']([^"'']+)["'']', 1) AS image FROM (SELECT page_id, '<META content="https://i.example/' || page_id || '.png" property=''og:image''>' || html AS h FROM pages)""")
def fn_og_image(spark, sf):
    page = F.expr("""concat('<META content="https://i.example/', page_id, ".png\\" property='og:image'>", html)""")
    return views.read(spark, sf, "pages").select("page_id", text.og_image(page).alias("image"))


@query("""WITH l AS (SELECT conv_id, turn, trim(split_part(ltrim(text, E' \\n\\t'), chr(10), 1), E' \\t') AS line FROM conversations)
SELECT conv_id, turn, CASE WHEN length(line) <= 60 THEN line ELSE regexp_replace(left(line, 60), '\\s+\\S*$', '') || '…' END AS title FROM l""")
def fn_post_title(spark, sf):
    return views.read(spark, sf, "conversations").select("conv_id", "turn", text.post_title(F.col("text"), 60).alias("title"))


@query("SELECT doc_id, 'Doc ' || doc_id AS title FROM documents")
def fn_extract_title(spark, sf):
    return views.read(spark, sf, "documents").select("doc_id", text.heading(F.expr(r"concat('intro\n# Doc ', doc_id, ' \n', text)")).alias("title"))


@query(f"WITH {A} SELECT doc_id, coalesce(nullif(category, 'auto'), left(action_description, 300), '') AS description, coalesce(nullif(published_at, ''), CASE WHEN content_kind = 'social' THEN source_name || ' LinkedIn post' END, '') AS title FROM articles")
def fn_fallbacks(spark, sf):
    """Descriptions and titles where the own ones are blank."""
    own = F.when(F.col("category") != "auto", F.col("category")).otherwise("")
    return views.articles(spark, sf).select("doc_id", text.action_description(own, F.col("action_description")).alias("description"), text.title_or_source(F.col("published_at"), F.col("source_name"), F.col("content_kind")).alias("title"))


@query("""WITH c AS (SELECT c_custkey, list_transform(string_split(lower(trim(c_name)), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS k FROM customer),
h AS (SELECT c_custkey, list_reduce(list_prepend(CAST(5381 AS BIGINT), k), lambda h, x: xor((h * 33) & 4294967295, x)) AS h FROM c)
SELECT c_custkey, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 8 AS slot FROM h""")
def fn_company_color(spark, sf):
    return views.read(spark, sf, "customer").select("c_custkey", text.color_slot(F.col("c_name")).alias("slot"))


@query(f"WITH {A} SELECT doc_id, CASE WHEN published_at = '' THEN false ELSE left(published_at, 10) = '2024-01-15' END AS today FROM articles")
def dt_is_today(spark, sf):
    return views.articles(spark, sf).select("doc_id", dates.same_day(F.col("published_at"), F.expr("timestamp'2024-01-15 12:00:00'")).alias("today"))


@query("SELECT event_id, strftime(TIMESTAMP '2024-02-01' - to_days(CAST(event_id % 40 AS INT)), '%Y-%m-%d') AS estimated, strftime(TIMESTAMP '2024-02-01' - to_hours(CAST(event_id % 40 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS since FROM events")
def dt_estimated(spark, sf):
    """Dates from relative ages, and the start of look-back windows."""
    at = F.expr("timestamp'2024-02-01 00:00:00'")
    return views.read(spark, sf, "events").select("event_id", F.date_format(dates.estimated_date(at, F.col("event_id") % 40), "yyyy-MM-dd").alias("estimated"), dates.window_since(at, F.col("event_id") % 40).alias("since"))


@query("SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 1000 + event_id % 900 WHEN 1 THEN event_id % 900 ELSE 0 END AS INT) AS n FROM events")
def num_count(spark, sf):
    raw = F.expr("case event_id % 3 when 0 then concat('1,', lpad(event_id % 900, 3, '0')) when 1 then cast(event_id % 900 as string) else 'many' end")
    return views.read(spark, sf, "events").select("event_id", payloads.grouped_count(raw).alias("n"))


@query("""WITH r AS (SELECT page_id, html, CASE page_id % 4 WHEN 0 THEN 403 WHEN 1 THEN 200 WHEN 2 THEN 500 END AS status, page_id % 3 <> 0 AS success, left(html, CAST(page_id % 400 AS INT)) AS markdown FROM pages),
c AS (SELECT *, (contains(lower(html), 'captcha') OR contains(lower(markdown), 'captcha')) AS hit, length(trim(lower(markdown), E' \\n\\t\\r')) < 200 AS short, status IS NULL OR status BETWEEN 200 AND 399 AS fine FROM r)
SELECT page_id, coalesce(status IN (403, 429), false) OR (hit AND (NOT success OR (fine AND short))) OR (success AND short AND fine) AS blocked FROM c""")
def flt_blocked(spark, sf):
    rows = views.read(spark, sf, "pages").selectExpr("page_id", "named_struct('success', page_id % 3 <> 0, 'status', cast(case page_id % 4 when 0 then 403 when 1 then 200 when 2 then 500 end as int), 'url', url, 'html', html, 'markdown', substring(html, 1, cast(page_id % 400 as int)), 'error', cast(null as string), 'exception', cast(null as string)) r")
    return rows.select("page_id", social.blocked_page(F.col("r"), ["Captcha"], [403, 429], 200).alias("blocked"))


@query("SELECT page_id, page_id % 3 = 0 OR page_id % 5 = 0 OR page_id % 7 = 0 AS blocked FROM pages")
def flt_social_blocked(spark, sf):
    rows = views.read(spark, sf, "pages").selectExpr("page_id", "named_struct('success', page_id % 3 <> 0, 'status', case when page_id % 5 = 0 then 999 else 200 end, 'url', case when page_id % 7 = 0 then 'https://x.example/login' else 'https://x.example/' end, 'markdown', 'm') r")
    return rows.select("page_id", social.blocked_social(F.col("r")).alias("blocked"))


@query("SELECT s_suppkey, 'https://www.linkedin.com/' || CASE WHEN s_suppkey % 3 = 0 THEN 'showcase/x' ELSE 'company/y' END || s_suppkey || '/' AS url FROM supplier")
def src_social_url(spark, sf):
    slug = F.expr("case when s_suppkey % 3 = 0 then concat('showcase/x', s_suppkey) else concat('y', s_suppkey) end")
    return views.read(spark, sf, "supplier").select("s_suppkey", social.company_page(slug).alias("url"))


@query("SELECT event_id, 'v' || CASE WHEN event_id % 10 > 4 THEN 'a' ELSE 'b' END AS src, CASE WHEN event_id % 2 = 0 THEN 'p&q' END AS poster FROM events")
def js_video(spark, sf):
    """The source of the highest bit rate, four against the event's last digit."""
    tag = F.expr("""concat('<video ', case when event_id % 2 = 0 then 'poster="p&amp;q" ' else '' end, 'data-sources="[{&quot;src&quot;:&quot;vb&quot;,&quot;data-bitrate&quot;:4},{&quot;src&quot;:&quot;va&quot;,&quot;data-bitrate&quot;:', event_id % 10, '}]">')""")
    return views.read(spark, sf, "events").select("event_id", payloads.best_video(tag).alias("v")).select("event_id", "v.src", "v.poster")
