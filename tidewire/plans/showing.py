"""Queries in Spark SQL over the registered names; catalogs and targets out of tables; links, posts and their media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import social, text
from tidewire.plans import surface, views
from tidewire.plans.catalog import A, I, _LOOKUP, _TOKENS, _verdict, query
from tidewire.sources import readers, targets


def _session(spark: SparkSession, sf: str, *names: str) -> SparkSession:
    """A session of its own with the library's functions and views, so that the caller's has no new names."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    tables = {n: getattr(views, n)(own, sf) if hasattr(views, n) else views.read(own, sf, n) for n in names}
    return surface.register(own, tables)


# Spark SQL ------------------------------------------------------------------------------------------


@query(f"""WITH {A} SELECT regexp_replace(split_part(lower(link), '#', 1), '/$', '') AS url, count(*) AS n, count(DISTINCT source_id) AS sources FROM articles GROUP BY 1""")
def sql_canonicalize_url(spark, sf):
    return _session(spark, sf, "articles").sql("SELECT canonicalize_url(link) AS url, count(*) AS n, count(DISTINCT source_id) AS sources FROM articles GROUP BY canonicalize_url(link)")


@query(f"""WITH {A}, k AS (SELECT article_hash, {_LOOKUP} AS h FROM articles) SELECT h AS hash, count(*) AS n, min(article_hash) AS first FROM k GROUP BY h HAVING count(*) > 1""")
def sql_title_hash(spark, sf):
    return _session(spark, sf, "articles").sql("SELECT title_hash(title) AS hash, count(*) AS n, min(article_hash) AS first FROM articles GROUP BY title_hash(title) HAVING count(*) > 1")


@query(f"""WITH {I}, t AS (SELECT rowid, {_TOKENS} AS k FROM items)
SELECT a.rowid, round(CASE WHEN len(a.k) + len(b.k) = 0 THEN 1.0 ELSE len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k)))::DOUBLE END, 9) AS score FROM t a JOIN t b ON b.rowid = a.rowid + 1""")
def sql_jaccard(spark, sf):
    """Each title against the next one's."""
    out = _session(spark, sf, "items").sql("SELECT a.rowid, round(jaccard(title_tokens(a.title), title_tokens(b.title)), 9) AS score FROM items a JOIN items b ON b.rowid = a.rowid + 1")
    return out


@query("""SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def sql_cosine(spark, sf):
    return _session(spark, sf, "embeddings").sql("SELECT a.vec_id, round(cosine(a.embedding, b.embedding), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")


@query(f"""WITH {A}, k AS (SELECT lower(title) AS t FROM articles), v AS (SELECT {_verdict(0, False)} AS event_type FROM k) SELECT event_type, count(*) AS n FROM v GROUP BY 1""")
def sql_classify_event(spark, sf):
    return _session(spark, sf, "articles").sql("SELECT classify_event(title).event_type AS event_type, count(*) AS n FROM articles GROUP BY 1")


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&#160;', ' '), '\s+', ' ', 'g')) AS text FROM pages""")
def sql_clean_text(spark, sf):
    return _session(spark, sf, "pages").sql("SELECT page_id, clean_text(html) AS text FROM pages")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN regexp_replace(text, '[^a-zA-Z ]', ' ', 'g') END AS summary FROM documents""")
def sql_parse_llm_json(spark, sf):
    """Answers that hold the whole text: bare, fenced, with words around, and broken ones."""
    return _session(spark, sf, "documents").sql(r"""
        WITH said AS (SELECT doc_id, regexp_replace(text, '[^a-zA-Z ]', ' ') AS t FROM documents),
        raw AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"summary": "' || t || '"}' WHEN 1 THEN '```json' || chr(10) || '{"summary": "' || t || '", "x": [1, {}]}' || chr(10) || '```'
                WHEN 2 THEN 'Here it is: {"summary": "' || t || '"} as asked' ELSE '{"summary": "' || t END AS raw FROM said)
        SELECT doc_id, try_variant_get(parse_llm_json(raw), '$.summary', 'string') AS summary FROM raw""")


# Catalogs and targets -------------------------------------------------------------------------------

_SOURCES = "SELECT c_custkey, 'c' || c_custkey AS source_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'https://f' || c_custkey || '.example/rss' WHEN c_custkey % 3 = 1 THEN '' END AS rss_url, CASE WHEN c_custkey % 5 = 1 THEN 'linkedin_company' END AS feed_type, CASE WHEN c_custkey % 7 > 2 THEN 'brake pads ' || c_custkey WHEN c_custkey % 5 = 1 THEN 'firm' || c_custkey END AS query_text, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS tag, CASE WHEN c_custkey % 11 = 0 THEN false END AS active FROM customer"


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """A source of each customer: feeds of their own, social pages and searches."""
    rows = views.read(spark, sf, "customer").selectExpr(
        "concat('c', c_custkey) source_id", "c_name name", "case when c_custkey % 3 = 0 then concat('https://f', c_custkey, '.example/rss') when c_custkey % 3 = 1 then '' end rss_url",
        "case when c_custkey % 5 = 1 then 'linkedin_company' end feed_type", "case when c_custkey % 7 > 2 then concat('brake pads ', c_custkey) when c_custkey % 5 = 1 then concat('firm', c_custkey) end query_text",
        "case when c_custkey % 2 = 0 then c_mktsegment end tag", "case when c_custkey % 11 = 0 then false end active",
    )
    return readers.with_defaults(rows)


@query(f"""WITH s AS ({_SOURCES}), d AS (SELECT *, CASE WHEN rss_url <> '' THEN 'rss_direct' ELSE coalesce(feed_type, 'google_news_query') END AS kind FROM s WHERE coalesce(active, true))
SELECT source_id, kind AS feed_type, CASE WHEN kind = 'linkedin_company' THEN 'social' ELSE 'news' END AS content_kind,
CASE WHEN kind = 'linkedin_company' THEN 'https://www.linkedin.com/company/' || query_text || '/' WHEN kind = 'rss_direct' THEN rss_url
ELSE 'https://news.google.com/rss/search?q=' || replace(replace(coalesce(query_text, tag, name), ' ', '%20'), '#', '%23') || '&hl=pt-BR&gl=BR&ceid=BR:pt-419' END AS url FROM d""")
def src_catalog(spark, sf):
    """The active sources of a catalog with a source for each customer, and where each is read."""
    rows = _sources(spark, sf).where("active")
    return rows.select("source_id", "feed_type", "content_kind", readers.feed_url(rows).alias("url"))


@query(f"WITH s AS ({_SOURCES}) SELECT source_id FROM s WHERE tag IN ('BUILDING', 'MACHINERY')")
def src_company_scope(spark, sf):
    return readers.in_scope(_sources(spark, sf), ["BUILDING", "MACHINERY"]).select("source_id")


_TARGETS = "SELECT CAST(p_partkey % 4 AS INTEGER) AS file, CAST(p_partkey AS INTEGER) AS pos, 't' || p_partkey % 700 AS slug, 'https://' || replace(p_name, ' ', '-') || '.example/' || p_partkey AS url, CASE WHEN p_size % 3 = 0 THEN p_name END AS title, CASE WHEN p_size % 2 = 0 THEN p_size END AS max_retries, CASE WHEN p_size % 5 = 0 THEN p_retailprice END AS backoff_seconds FROM part"


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    """Four files of targets out of the parts; a slug stands in several."""
    return views.read(spark, sf, "part").selectExpr(
        "cast(p_partkey % 4 as int) file", "cast(p_partkey as int) pos", "concat('t', p_partkey % 700) slug", "concat('https://', replace(p_name, ' ', '-'), '.example/', p_partkey) url",
        "case when p_size % 3 = 0 then p_name end title", "case when p_size % 2 = 0 then p_size end max_retries", "case when p_size % 5 = 0 then p_retailprice end backoff_seconds", "cast(null as int) min_content_chars",
    )


@query(f"""WITH t AS ({_TARGETS}), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY file, pos) AS a, row_number() OVER (PARTITION BY slug ORDER BY file DESC, pos DESC) AS z FROM t)
SELECT l.slug, l.url, f.file, f.pos, l.title FROM n l JOIN n f ON f.slug = l.slug AND f.a = 1 WHERE l.z = 1""")
def cfg_merge(spark, sf):
    return targets.merged(_targets(spark, sf)).select("slug", "url", "file", "pos", "title")


@query(f"WITH t AS ({_TARGETS}) SELECT pos, coalesce(max_retries, 3) AS max_retries, coalesce(backoff_seconds, 5.0) AS backoff_seconds, 300 AS min_content_chars FROM t")
def cfg_override(spark, sf):
    out = targets.overridden(_targets(spark, sf), {"max_retries": 3, "min_content_chars": 300})
    return out.select("pos", "max_retries", "backoff_seconds", "min_content_chars")


# Links, posts and media -----------------------------------------------------------------------------


@query(r"""WITH s AS (SELECT page_id, regexp_extract_all(html, '<h1>|<p>|<li>|<br>|href="[^"]*"') AS t FROM pages), u AS (SELECT page_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM s),
l AS (SELECT page_id, pos, token, last_value(CASE WHEN token LIKE 'href%' THEN regexp_extract(token, 'href="([^"]*)"', 1) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS url FROM u)
SELECT page_id, url, token, count(*) AS n FROM l WHERE token NOT LIKE 'href%' AND url IS NOT NULL GROUP BY ALL""")
def jn_href(spark, sf):
    """What stands under each link of a page until the next one."""
    stream = social.stream_of(views.read(spark, sf, "pages"), "html", "page_id", '<h1>|<p>|<li>|<br>|href="[^"]*"')
    marks = stream.where("href is not null").select("page_id", "pos", F.col("href").alias("url"))
    return social.under_links(stream.where("href is null"), marks, "page_id").groupBy("page_id", "url", "token").agg(F.count("*").alias("n"))


_WORDS = "trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'))"


def _company_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A rendered company page of each document: three posts, the first with the whole text and two images, the second old, the third with a video."""
    url = "https://www.linkedin.com/posts/firm-activity-"
    words = "trim(regexp_replace(text, '[^a-zA-Z]+', ' '))"
    posts = [("3d", "0", f"{words}"), ("2mo", "1", "'an old one'"), ("5h", "2", "concat('third of ', doc_id)")]
    markdown = ", ".join(
        f"'\\n * [ ]({url}', doc_id * 10 + {k}, ')\\n  {age} \\nReport this post \\n', {said}, ' …more\\n[ 1,', lpad(doc_id % 900, 3, '0'), ' ](https://x/social-actions-reactions)\\n[ ', doc_id % 50, ' Comments ](https://x/social-actions-comments)\\n'"
        for age, k, said in posts
    )
    image = lambda k: f"'<img src=\"https://media.licdn.com/dms/image/', doc_id, '/feedshare-shrink_{k}?a=1&amp;b=2\">'"
    link = lambda k: f"'<a href=\"{url}', doc_id * 10 + {k}, '?x=1\">'"
    video = "'<video poster=\"p.jpg\" data-sources=\"[{&quot;src&quot;:&quot;lo&quot;,&quot;data-bitrate&quot;:1},{&quot;src&quot;:&quot;hi', doc_id, '&quot;,&quot;data-bitrate&quot;:9}]\"></video>'"
    html = ", ".join([image(9), link(0), image(1), image(2), link(1), image(3), link(2), video])
    return views.read(spark, sf, "documents").selectExpr("doc_id as page_id", f"concat('# Firm\\n', '\\n##  updates\\n', {markdown}, '\\n## Other\\n') as markdown", f"concat('<html>', {html}, '</html>') as html", "timestamp'2024-03-10 12:00:00' as fetched_at")


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT doc_id, 0 AS pos, w AS said FROM d UNION ALL SELECT doc_id, 2, 'third of ' || doc_id FROM d)
SELECT doc_id AS page_id, CAST(pos AS INTEGER) AS pos, 'https://www.linkedin.com/posts/firm-activity-' || doc_id * 10 + pos AS link, CASE pos WHEN 0 THEN '2024-03-07' ELSE '2024-03-10' END AS published_at, said AS action_description,
CASE pos WHEN 0 THEN 'https://media.licdn.com/dms/image/' || doc_id || '/feedshare-shrink_1?a=1&b=2' ELSE 'p.jpg' END AS image_url, CASE pos WHEN 0 THEN 3 ELSE 0 END AS images,
1000 + doc_id % 900 AS reactions, doc_id % 50 AS comments, CASE pos WHEN 2 THEN 'hi' || doc_id END AS video FROM p""")
def src_social(spark, sf):
    """Company pages end to end: the section, its posts within thirty days, the media under each up to the next recent one, and the feed items."""
    items = social.social_items(_company_pages(spark, sf), "markdown", "html", "fetched_at", "page_id")
    extra = lambda path: F.get_json_object("extra", path)
    video = F.get_json_object(F.get(F.from_json(extra("$.videos"), "array<string>"), 0), "$.src")
    return items.select(
        "page_id", F.col("pos").cast("int").alias("pos"), "link", "published_at", "action_description", "image_url", F.size("image_urls").alias("images"),
        extra("$.reactions").cast("long").alias("reactions"), extra("$.comments").cast("long").alias("comments"), video.alias("video"),
    )


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')) AS clean FROM pages")
def fn_clean_html(spark, sf):
    return views.read(spark, sf, "pages").select("page_id", text.clean_html(F.col("html")).alias("clean"))


@query(f"WITH {A} SELECT article_hash, CASE source_id WHEN 'src0' THEN 'High' WHEN 'src1' THEN 'Medium' WHEN 'src2' THEN 'Low' ELSE source_id END AS label FROM articles")
def fn_alert_label(spark, sf):
    level = F.expr("case source_id when 'src0' then 'Alto' when 'src1' then 'Medio' when 'src2' then 'Baixo' else source_id end")
    return views.articles(spark, sf).select("article_hash", text.alert_label(level).alias("label"))


@query("SELECT event_id, 'agent-' || (event_id % 7) % 3 AS agent FROM events")
def fn_pick_ua(spark, sf):
    """The agent of an event's attempt, out of three."""
    agents = F.array(*(F.lit(f"agent-{k}") for k in range(3)))
    return views.read(spark, sf, "events").select("event_id", text.picked_agent(agents, F.col("event_id") % 7).alias("agent"))
