"""Named queries over the derived tables, each with the SQL it is held against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates, payloads, rules, social, text
from tidewire.operators import cascade, dedup, feed, similarity, store
from tidewire.plans import views
from tidewire.sources import readers, writers
from tidewire.streaming import jobs, keyed_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
A, I, FD, FE = views.ARTICLES_SQL, views.ITEMS_SQL, views.FEED_SQL, views.FETCHES_SQL
AS_OF = "timestamp'2024-02-01 00:00:00'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _alternation(words: tuple[str, ...]) -> str:
    return rules.pattern(words).replace("'", "''")


# Feeds ----------------------------------------------------------------------------------------


@query(f"WITH {A} SELECT article_hash, title, published_at, sort_key FROM pub ORDER BY sort_key DESC LIMIT 20")
def srt_latest(spark, sf):
    return feed.latest(views.articles(spark, sf)).select("article_hash", "title", "published_at", "sort_key")


@query(f"WITH {A} SELECT article_hash, sort_key FROM pub WHERE coalesce(content_kind, 'news') = 'social' ORDER BY sort_key DESC LIMIT 50")
def srt_kind(spark, sf):
    return feed.latest(views.articles(spark, sf), 50, "social").select("article_hash", "sort_key")


_TAGGED = "list_contains(list_filter(list_transform(string_split(tag, ','), lambda x: trim(x)), lambda x: x <> ''), '{0}')"


@query(f"WITH {A} SELECT article_hash, sort_key FROM pub WHERE {_TAGGED.format('src3')} AND sort_key >= '2024-01-05' AND sort_key <= '2024-01-25￿' AND coalesce(content_kind, 'news') = 'news' ORDER BY sort_key DESC LIMIT 100")
def srt_company(spark, sf):
    return feed.of_companies(views.articles(spark, sf), ["src3"], "news", "2024-01-05", "2024-01-25", 100).select("article_hash", "sort_key")


_TWO = f"CASE WHEN {_TAGGED.format('src0')} THEN 'src0' WHEN {_TAGGED.format('src1')} THEN 'src1' END"


@query(f"WITH {A} SELECT article_hash, company, title, sort_key FROM (SELECT *, {_TWO} AS company FROM pub) WHERE company IS NOT NULL ORDER BY sort_key DESC LIMIT 20")
def srt_companies(spark, sf):
    return feed.of_companies(views.articles(spark, sf), ["src0", "src1"]).select("article_hash", "company", "title", "sort_key")


@query(f"""WITH {A}, ranked AS (SELECT *, CASE company WHEN 'src2' THEN 1 ELSE 2 END AS place, row_number() OVER (PARTITION BY company ORDER BY published_at DESC, article_hash DESC) AS n FROM company WHERE company IN ('src2', 'src12')),
firsts AS (SELECT *, row_number() OVER (PARTITION BY article_hash ORDER BY place) AS m FROM ranked WHERE n <= 15)
SELECT article_hash, company, published_at FROM firsts WHERE m = 1 ORDER BY published_at DESC, place, article_hash DESC LIMIT 20""")
def srt_store_companies(spark, sf):
    return feed.store_companies(store.company_rows(views.articles(spark, sf)), ["src2", "src12"], 15, 20).select("article_hash", "company", "published_at")


@query(f"WITH {A} SELECT article_hash, sort_key FROM (SELECT article_hash, sort_key, row_number() OVER (ORDER BY sort_key DESC) AS n FROM pub) WHERE n > 20 AND n <= 40")
def pag_keyset(spark, sf):
    """The second page, from the first page's last key."""
    rows = views.articles(spark, sf)
    last = feed.latest(rows).agg(F.min("sort_key")).first()[0]
    return feed.latest(rows, cursor=payloads.encode_cursor({"sort_key": last} if last else None)).select("article_hash", "sort_key")


@query(f"""WITH {A}, page AS (SELECT article_hash, row_number() OVER (ORDER BY sort_key DESC) AS n FROM pub)
SELECT article_hash, CASE WHEN n <= 20 THEN 0 ELSE 1 END AS page FROM page WHERE n <= 30""")
def pag_loadmore(spark, sf):
    rows = views.articles(spark, sf)
    return feed.load_more(feed.latest(rows, 20).select("article_hash"), feed.latest(rows, 30).select("article_hash"))


@query(f"""WITH {A}, top AS (SELECT *, row_number() OVER (ORDER BY sort_key DESC) AS rank FROM pub ORDER BY sort_key DESC LIMIT 100),
firms AS (SELECT article_hash, rank, generate_subscripts(f, 1) AS pos, unnest(f) AS company FROM (SELECT article_hash, rank, list_filter(list_transform(string_split(tag, ','), lambda x: trim(x)), lambda x: x <> '') AS f FROM top)),
own AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY rank, pos) AS n FROM firms)
SELECT article_hash, company, CAST(rank AS BIGINT) AS rank FROM own WHERE n = 1 ORDER BY rank, pos LIMIT 8""")
def win_top1_company(spark, sf):
    return feed.highlights(views.articles(spark, sf)).select("article_hash", "company", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {A}, ranked AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY published_at DESC, article_hash DESC) AS n FROM company WHERE company IN ('src4', 'src14'))
SELECT article_hash, company, published_at FROM ranked WHERE n <= 24 AND left(published_at, 10) BETWEEN '2024-01-10' AND '2024-01-31'""")
def srt_fe_feed(spark, sf):
    return feed.merged_pages(store.company_rows(views.articles(spark, sf)), ["src4", "src14"], 24, "2024-01-10", "2024-01-31").select("article_hash", "company", "published_at")


@query(f"""WITH {FD}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published DESC NULLS LAST, pos) AS rank FROM feed WHERE published IS NULL OR published >= TIMESTAMP '2024-01-10')
SELECT source, event_id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 40""")
def win_feed_cap(spark, sf):
    out = feed.newest_per_feed(views.feed_items(spark, sf), 40, min_date=F.expr("timestamp_ntz'2024-01-10 00:00:00'"))
    return out.select("source", "event_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FD} SELECT source, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS n FROM feed) WHERE n <= 25")
def win_rss_cap(spark, sf):
    return feed.first_per_feed(views.feed_items(spark, sf)).select("source", "event_id")


@query(f"""WITH {FD} SELECT source, count(*) AS total, count(*) FILTER (published IS NULL OR published >= TIMESTAMP '2024-01-10') AS in_window,
least(count(*) FILTER (published IS NULL OR published >= TIMESTAMP '2024-01-10'), 500) AS kept FROM feed GROUP BY source""")
def agg_news_funnel(spark, sf):
    out = feed.feed_funnel(views.feed_items(spark, sf), 500, F.expr("timestamp_ntz'2024-01-10 00:00:00'"))
    return out.withColumn("kept", F.col("kept").cast("long"))


# The store -------------------------------------------------------------------------------------


@query(f"WITH {A} SELECT article_hash FROM pub")
def flt_public(spark, sf):
    return store.public(views.articles(spark, sf)).select("article_hash")


@query(f"""WITH {A} SELECT article_hash, title, link, '' AS image_url, '' AS summary, action_description, '' AS competitor_analysis, category, '' AS event_type, '' AS alert_level,
coalesce(summary_status, '') AS summary_status, published_at, source_name, '' AS image_urls, coalesce(content_kind, 'news') AS content_kind, '' AS companies FROM articles""")
def prj_public(spark, sf):
    out = store.public_shape(views.articles(spark, sf))
    return out.withColumn("image_urls", F.array_join("image_urls", "|")).withColumn("companies", F.array_join("companies", "|"))


@query(f"WITH {A} SELECT article_hash, title, category, coalesce(content_kind, 'news') AS content_kind, coalesce(summary_status, 'pending') AS summary_status, coalesce(dedup_decision, '') AS dedup_decision FROM articles")
def prj_full(spark, sf):
    return store.full(views.articles(spark, sf)).select("article_hash", "title", "category", "content_kind", "summary_status", "dedup_decision")


@query(f"WITH {A} SELECT article_hash, nullif(published_at, '') AS published_at, nullif(tag, '') AS tag, sort_key FROM keyed")
def prj_base(spark, sf):
    return store.base_rows(views.articles(spark, sf)).select("article_hash", "published_at", "tag", "sort_key")


@query(f"WITH {A} SELECT article_hash, company, published_at, category FROM company")
def prj_company(spark, sf):
    return store.company_rows(views.articles(spark, sf)).select("article_hash", "company", "published_at", "category")


_QUEUE = "category IN ('auto', 'economia', 'tecnologia') AND dedup_decision IS DISTINCT FROM 'duplicate'"


@query(f"WITH {A} SELECT article_hash, collected_at FROM articles WHERE summary_status = 'pending' AND {_QUEUE} ORDER BY collected_at, article_hash LIMIT 50")
def flt_queue(spark, sf):
    return store.queue(views.articles(spark, sf), "pending", 50).select("article_hash", "collected_at")


@query(f"WITH {A} SELECT article_hash, CASE WHEN summary_status = 'failed' AND {_QUEUE} THEN 'pending' ELSE summary_status END AS summary_status FROM articles")
def st_queue_retry(spark, sf):
    return store.retried(views.articles(spark, sf)).select("article_hash", "summary_status")


@query(f"WITH {A} SELECT coalesce(summary_status, '') AS summary_status, count(*) AS n FROM articles GROUP BY 1")
def agg_by_status(spark, sf):
    return store.count_by_status(views.articles(spark, sf))


@query(f"WITH {A} SELECT category, count(*) AS n FROM articles WHERE summary_status IS DISTINCT FROM 'irrelevant' GROUP BY 1")
def agg_by_category(spark, sf):
    return store.count_by_category(views.articles(spark, sf))


@query(f"WITH {A} SELECT count(*) AS n FROM articles WHERE summary_status IS DISTINCT FROM 'irrelevant'")
def agg_count(spark, sf):
    return store.visible(views.articles(spark, sf)).agg(F.count("*").alias("n"))


@query(f"WITH {A} SELECT article_hash, coalesce(content_kind, CASE WHEN feed_type = 'linkedin_company' THEN 'social' ELSE 'news' END) AS content_kind FROM articles")
def adm_backfill_kind(spark, sf):
    return store.backfilled_kind(views.articles(spark, sf)).select("article_hash", "content_kind")


@query(f"WITH {A} SELECT article_hash FROM articles WHERE summary_status IN ('pending', 'failed') AND doc_id % 6 = 1")
def adm_fix_status(spark, sf):
    rows = views.articles(spark, sf).withColumn("status_key", F.when(F.col("doc_id") % 6 == 1, "STATUS#old").otherwise(F.concat(F.lit("STATUS#"), "summary_status")))
    return store.stale_status_keys(rows).select("article_hash")


@query(f"WITH {A} SELECT doc_id, md5(raw_link) AS article_hash FROM (SELECT *, row_number() OVER (PARTITION BY raw_link ORDER BY doc_id) AS n FROM articles WHERE doc_id % 2 = 0) x WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM articles y WHERE y.doc_id % 2 = 1 AND y.raw_link = x.raw_link)")
def snk_article(spark, sf):
    """Even rows into a store of the odd ones, keyed by link: unknown hashes, the first of each."""
    rows = views.articles(spark, sf).withColumn("article_hash", F.md5("raw_link"))
    return store.insert_new(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), ["doc_id"]).select("doc_id", "article_hash")


@query(f"WITH {A} SELECT article_hash, CASE WHEN doc_id % 5 = 0 THEN 'ai_generated' ELSE summary_status END AS summary_status, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS version FROM articles")
def snk_update(spark, sf):
    rows = views.articles(spark, sf).withColumn("version", F.lit(1))
    changes = rows.where("doc_id % 5 = 0").select("article_hash", F.lit("ai_generated").alias("summary_status"))
    return store.current(rows.unionByName(store.update(rows, changes, 2))).select("article_hash", "summary_status", "version")


@query(f"WITH {I} SELECT rowid, created_at FROM items WHERE status = 'new' AND summarized_at IS NULL")
def flt_unsummarized(spark, sf):
    return store.unsummarized(views.items(spark, sf)).select("rowid", "created_at")


@query(f"WITH {I} SELECT rowid, CASE WHEN status = 'new' THEN NULL ELSE summarized_at END AS summarized_at FROM items")
def st_resummarize(spark, sf):
    return store.cleared_summaries(views.items(spark, sf)).select("rowid", "summarized_at")


@query(f"""WITH {FD} SELECT event_id % 150 AS user_id, max(event_id) AS event_id FROM feed GROUP BY 1""")
def win_version(spark, sf):
    rows = views.feed_items(spark, sf).select((F.col("event_id") % 150).alias("user_id"), F.col("event_id"), F.col("event_id").alias("version"), (F.col("event_id") % 150).cast("string").alias("article_hash"))
    return store.current(rows).select("user_id", "event_id")


# Lookups and duplicates --------------------------------------------------------------------------


@query(f"WITH {A} SELECT a.doc_id FROM articles a WHERE a.doc_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM articles b WHERE b.doc_id % 3 <> 0 AND b.raw_link = a.raw_link)")
def jn_rawlink(spark, sf):
    rows = views.articles(spark, sf)
    return dedup.unknown_raw_links(rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 <> 0")).select("doc_id")


@query(f"WITH {A} SELECT a.doc_id FROM articles a WHERE a.doc_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM articles b WHERE b.doc_id % 3 <> 0 AND b.summary_status IS DISTINCT FROM 'irrelevant' AND b.raw_link = a.raw_link)")
def jn_hash_lookup(spark, sf):
    rows = views.articles(spark, sf).withColumn("article_hash", F.md5("raw_link"))
    return dedup.unknown_hashes(rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 <> 0")).select("doc_id")


@query(f"""WITH {A}, v AS (SELECT article_hash, md5(regexp_replace(lower(split_part(trim(link), '#', 1)), '/$', '')) AS url_hash, summary_status FROM articles)
SELECT a.article_hash, a.url_hash FROM v a WHERE EXISTS (SELECT 1 FROM v b WHERE b.url_hash = a.url_hash AND b.article_hash <> a.article_hash AND b.summary_status IS DISTINCT FROM 'irrelevant')""")
def jn_xurl_dup(spark, sf):
    return dedup.cross_url_duplicates(views.articles(spark, sf), F.col("link")).select("article_hash", "url_hash")


_LOOKUP = "md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '\\s+', ' ', 'g'), '^breaking:\\s*', ''), '^update:\\s*', ''), '^news:\\s*', ''), '^just in:\\s*', ''))"


@query(f"""WITH {A}, k AS (SELECT *, {_LOOKUP} AS lookup FROM keyed)
SELECT a.article_hash, max_by(b.article_hash, b.sort_key) AS match FROM k a JOIN k b ON b.title_hash = a.lookup AND b.article_hash <> a.article_hash
AND b.summary_status IS DISTINCT FROM 'irrelevant' AND b.sort_key >= '2024-01-05T00:00:00' GROUP BY a.article_hash""")
def jn_title_window(spark, sf):
    return dedup.title_duplicates(views.articles(spark, sf), "2024-01-05T00:00:00")


@query(f"""WITH {A}, k AS (SELECT *, {_LOOKUP} AS lookup FROM keyed), f AS (SELECT article_hash, first_value(article_hash) OVER (PARTITION BY lookup ORDER BY collected_at, article_hash) AS m FROM k)
SELECT article_hash, CASE WHEN m = article_hash THEN 'new' ELSE 'duplicate' END AS dedup_decision, CASE WHEN m <> article_hash THEN 1 END AS dedup_layer, CASE WHEN m <> article_hash THEN m END AS dedup_match FROM f""")
def dd2_keep_first(spark, sf):
    return dedup.run_titles(views.articles(spark, sf), "2024-01-05T00:00:00", "keep_first")


@query(f"""WITH {A}, k AS (SELECT *, {_LOOKUP} AS lookup FROM keyed), d AS (SELECT a.article_hash, EXISTS (SELECT 1 FROM k b WHERE b.title_hash = a.lookup AND b.article_hash <> a.article_hash
AND b.summary_status IS DISTINCT FROM 'irrelevant' AND b.sort_key >= '2024-01-05T00:00:00') AS dup FROM k a) SELECT CASE WHEN dup THEN 'duplicate' ELSE 'new' END AS dedup_decision, count(*) AS n FROM d GROUP BY 1""")
def agg_dedup_summary(spark, sf):
    return dedup.run_titles(views.articles(spark, sf), "2024-01-05T00:00:00").groupBy("dedup_decision").agg(F.count("*").alias("n"))


@query(f"WITH {I} SELECT id_hash, arg_min(rowid, created_at) AS primary FROM items WHERE status = 'new' GROUP BY 1".replace("AS primary", 'AS "primary"'))
def jn_sql_id(spark, sf):
    return dedup.primary_by_id(views.items(spark, sf))


@query(f"WITH {I} SELECT title_hash, arg_max(rowid, created_at) AS latest FROM items WHERE status = 'new' AND created_at >= 1704070000 GROUP BY 1")
def jn_sql_title(spark, sf):
    return dedup.latest_by_title(views.items(spark, sf), 1704070000)


_SCOPE = _alternation(rules.OUT_OF_SCOPE)
_DROP = f"""CASE WHEN regexp_matches(published_at, 'T.*(Z|[+-]\\d\\d:?\\d\\d)$') AND published_at < '2024-01-08' THEN 'cutoff' WHEN regexp_matches(lower(title || ' ' || action_description), '{_SCOPE}') THEN 'scope'
WHEN doc_id % 9 = 1 THEN 'raw_dedup' WHEN doc_id % 9 = 2 THEN 'hash_dedup' WHEN doc_id % 9 = 3 THEN 'unresolved' END"""


@query(f"""WITH {A}, r AS (SELECT source_id AS source, {_DROP} AS why FROM articles)
SELECT source, count(*) AS found, {', '.join(f"count(*) FILTER (why = '{n}') AS dropped_{n}" for n in ('cutoff', 'scope', 'raw_dedup', 'hash_dedup', 'unresolved'))}, count(*) FILTER (why IS NULL) AS "new",
count(*) FILTER (why IN ('raw_dedup', 'hash_dedup')) AS duplicate FROM r GROUP BY source""")
def agg_run_funnel(spark, sf):
    rows = views.articles(spark, sf).withColumnRenamed("source_id", "source")
    old = ~dates.after_cutoff(F.col("published_at"), F.to_timestamp(F.lit("2024-01-08T00:00:00Z")))
    scope = rules.out_of_scope(F.concat_ws(" ", "title", "action_description"))
    reasons = [("cutoff", old), ("scope", scope), ("raw_dedup", F.expr("doc_id % 9 = 1")), ("hash_dedup", F.expr("doc_id % 9 = 2")), ("unresolved", F.expr("doc_id % 9 = 3"))]
    return dedup.run_funnel(dedup.drop_reasons(rows, reasons))


_TOKENS = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '([\\p{L}\\p{N}_]+)'), lambda w: length(w) > 1)))"


@query(f"""WITH {I}, t AS (SELECT rowid, {_TOKENS} AS k FROM items),
c AS (SELECT k, min(rowid) AS first FROM t GROUP BY k),
e AS (SELECT a.k, min(b.first) AS m FROM c a JOIN c b ON (len(a.k) = 0 AND len(b.k) = 0) OR len(list_intersect(a.k, b.k)) > 0.4 * (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) GROUP BY a.k)
SELECT t.rowid AS id, e.m AS match FROM t JOIN e ON t.k = e.k WHERE e.m < t.rowid""")
def jn_jaccard(spark, sf):
    return similarity.first_similar(views.items(spark, sf))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 25 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM q JOIN embeddings v ON v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(n AS BIGINT) AS rank FROM r WHERE n <= 10""")
def jn_knn(spark, sf):
    v = views.read(spark, sf, "embeddings")
    out = similarity.top_cosine(v.where("vec_id % 25 = 0"), v, 10)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH a AS (SELECT vec_id AS id, label * 1.0 + vec_id / 100000.0 AS c FROM embeddings), b AS (SELECT vec_id AS id, label * 1.0 - vec_id % 7 AS r FROM embeddings),
ra AS (SELECT * FROM (SELECT id, c, row_number() OVER (ORDER BY c DESC, id) AS n FROM a) WHERE n <= 60), rb AS (SELECT * FROM (SELECT id, row_number() OVER (ORDER BY r DESC, id) AS n FROM b) WHERE n <= 30)
SELECT coalesce(ra.id, rb.id) AS id, round(coalesce(0.6 / ra.n, 0) + coalesce(0.4 / rb.n, 0), 9) AS score, round(CAST(coalesce(ra.c, 0) AS DOUBLE), 6) AS cosine
FROM ra FULL JOIN rb ON ra.id = rb.id ORDER BY coalesce(0.6 / ra.n, 0) + coalesce(0.4 / rb.n, 0) DESC, 1 LIMIT 30""")
def win_rrf(spark, sf):
    v = views.read(spark, sf, "embeddings")
    knn = v.selectExpr("vec_id as id", "label * 1.0D + vec_id / 100000.0D as cosine")
    return similarity.hybrid(knn, v.selectExpr("vec_id as id", "label * 1.0D - vec_id % 7 as relevance"), 30).select("id", F.round("score", 9).alias("score"), F.round("cosine", 6).alias("cosine"))


@query()
def dd5_cascade(spark, sf):
    """The whole cascade with neighbours from the vectors; held against a sequential scan in the tests."""
    v = views.read(spark, sf, "embeddings")
    near = similarity.top_cosine(v, v, 10, earlier=True, over=0.85).selectExpr("query_id a", "vec_id b", "score")
    items = views.items(spark, sf)
    return cascade.resolve(items, near, now=items.agg(F.max("created_at")).first()[0])


# Expressions -------------------------------------------------------------------------------------

_CANON = "lower(regexp_replace(split_part(trim(url), '#', 1), '/$', ''))"


@query(f"SELECT page_id, {_CANON} AS canonical, md5({_CANON}) AS id_hash FROM pages")
def fn_canon_url(spark, sf):
    p = views.read(spark, sf, "pages")
    return p.select("page_id", text.canonical_url(F.col("url")).alias("canonical"), text.id_hash(F.col("url"), F.col("page_id").cast("string")).alias("id_hash"))


@query(f"WITH {A} SELECT doc_id, {_LOOKUP} AS lookup, title_hash FROM articles")
def fn_norm_title(spark, sf):
    return views.articles(spark, sf).select("doc_id", text.lookup_title_hash(F.col("title")).alias("lookup"), text.stored_title_hash(F.col("title")).alias("title_hash"))


_VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gs'), '<style[^>]*>.*?</style>', ' ', 'gs'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')"


@query(f"SELECT page_id, md5({_VISIBLE}) AS visible, length({_VISIBLE}) AS n FROM pages")
def fn_visible_text(spark, sf):
    c = text.visible_text(F.col("html"))
    return views.read(spark, sf, "pages").select("page_id", F.md5(c).alias("visible"), F.length(c).cast("long").alias("n"))


def _stripped(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for entity, plain in text.ENTITIES:
        out = f"replace({out}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5({_stripped('html')}) AS stripped FROM pages")
def fn_strip_html(spark, sf):
    return views.read(spark, sf, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("stripped"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[#[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '#\S+', '', 'g'), 'https?://\S+', '', 'g'), '[ \t]+', ' ', 'g'), E' \n\t') AS cleaned FROM documents""")
def fn_clean_scraped(spark, sf):
    return views.read(spark, sf, "documents").select("doc_id", text.clean_scraped(F.col("text")).alias("cleaned"))


@query("SELECT DISTINCT source, replace(source, 'src', 'src-') AS slug FROM documents")
def fn_slug_source(spark, sf):
    names = views.read(spark, sf, "documents").select("source").distinct()
    return names.select("source", text.source_slug(F.replace("source", F.lit("src"), F.lit("SRC / "))).alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || E'\\n\\n[...truncated...]' ELSE text END AS cut, left(trim(text, E' \\n\\t\\r\\f\\x0b'), 40) AS head FROM documents")
def fn_truncate(spark, sf):
    return views.read(spark, sf, "documents").select("doc_id", text.truncated(F.col("text"), 300).alias("cut"), text.excerpt(F.col("text"), 40).alias("head"))


@query(f"WITH {A} SELECT doc_id, array_to_string(list_filter(list_transform(string_split(tag, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS companies FROM articles")
def fn_company_split(spark, sf):
    return views.articles(spark, sf).select("doc_id", F.array_join(text.companies(F.col("tag")), "|").alias("companies"))


@query(f"WITH {A} SELECT doc_id, len(k) AS n, array_to_string(k, ' ') AS tokens FROM (SELECT doc_id, {_TOKENS} AS k FROM articles)")
def set_tokens(spark, sf):
    k = F.array_sort(text.tokens(F.col("title")))
    return views.articles(spark, sf).select("doc_id", F.size(k).cast("long").alias("n"), F.array_join(k, " ").alias("tokens"))


@query(f"""WITH {A}, t AS (SELECT doc_id, {_TOKENS} AS k FROM articles)
SELECT a.doc_id, round(CASE WHEN len(a.k) = 0 AND len(b.k) = 0 THEN 1.0 ELSE len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) END, 6) AS score FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def set_jaccard(spark, sf):
    t = views.articles(spark, sf).select("doc_id", text.tokens(F.col("title")).alias("k"))
    n = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("k").alias("o"))
    return t.join(n, "doc_id").select("doc_id", F.round(text.jaccard(F.col("k"), F.col("o")), 6).alias("score"))


@query("""SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score,
CASE WHEN list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.2 THEN 'duplicate' WHEN list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.0 THEN 'ambiguous' ELSE 'new' END AS band
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vec_cosine(spark, sf):
    v = views.read(spark, sf, "embeddings")
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    s = payloads.cosine(F.col("embedding"), F.col("o"))
    return v.join(n, "vec_id").select("vec_id", F.round(s, 6).alias("score"), payloads.similarity_band(s, 0.0, 0.2).alias("band"))


def _verdict(part: int, scoped: bool = True) -> str:
    launch, parts = _alternation(rules.LAUNCH), _alternation(rules.PARTS)
    t = "t"
    out = "CASE" + (f" WHEN regexp_matches({t}, '{_SCOPE}') THEN '{('Atualizacao', 'Baixo')[part]}'" if scoped else "")
    out += f" WHEN regexp_matches({t}, '{launch}') AND regexp_matches({t}, '{parts}') THEN '{('Lancamento', 'Alto')[part]}' WHEN regexp_matches({t}, '{launch}') THEN '{('Institucional', 'Medio')[part]}'"
    for topic in rules.TOPICS:
        out += f" WHEN regexp_matches({t}, '{_alternation(topic[2])}') THEN '{topic[part]}'"
    return out + f" ELSE '{('Atualizacao', 'Baixo')[part]}' END"


#: Sentences that rules apply to; a document's id picks one, so that every rule is met.
_PHRASES = ["nova linha de filtros", "estreia do time", "workshop de vendas", "prêmio anual", "fusão com rival", "reajuste da tabela de preço", "investe r$ 10", "distribuidor oficial", "expansão", "novo ceo", "ipca de maio", "feira do setor", "campeonato de futebol", "nada aqui", "amplia a linha de pastilhas"]


@query(f"WITH p AS (SELECT doc_id, lower({[x for x in _PHRASES]}[CAST(doc_id % {len(_PHRASES)} AS INT) + 1] || ' ' || coalesce(text, '')) AS t FROM documents), v AS (SELECT doc_id, {_verdict(0)} AS event_type, {_verdict(1)} AS alert_level FROM p) SELECT *, event_type = 'Lancamento' AS is_launch FROM v")
def cls_article(spark, sf):
    d = views.read(spark, sf, "documents")
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("doc_id") % len(_PHRASES) + 1).cast("int"))
    v = rules.classify_article(phrase, F.col("text"))
    return d.select("doc_id", v.alias("v")).select("doc_id", "v.event_type", "v.alert_level", "v.is_launch")


@query(f"WITH {A}, k AS (SELECT article_hash, lower(title || ' ' || action_description) AS t FROM articles WHERE summary_status = 'pending' AND {_QUEUE}) SELECT article_hash, {_verdict(0)} AS event_type, {_verdict(1)} AS alert_level, {_verdict(0)} = 'Lancamento' AS is_launch FROM k")
def cls_rerun(spark, sf):
    return store.reclassified(views.articles(spark, sf))


@query(f"WITH {A} SELECT doc_id FROM articles WHERE NOT regexp_matches(lower(title || ' ' || action_description), '{_SCOPE}')")
def flt_scope(spark, sf):
    return views.articles(spark, sf).where(~rules.out_of_scope(F.concat_ws(" ", "title", "action_description"))).select("doc_id")


@query(f"WITH {A} SELECT doc_id FROM articles WHERE NOT (regexp_matches(published_at, 'T.*(Z|[+-]\\d\\d:?\\d\\d)$') AND published_at < '2024-01-15')")
def flt_cutoff(spark, sf):
    return views.articles(spark, sf).where(dates.after_cutoff(F.col("published_at"), F.to_timestamp(F.lit("2024-01-15T00:00:00Z")))).select("doc_id")


@query(f"WITH {A} SELECT doc_id FROM keyed WHERE sort_key BETWEEN '2024-01-10' AND '2024-01-12￿'")
def flt_daterange_str(spark, sf):
    return feed.keyed(views.articles(spark, sf)).where(feed.within("2024-01-10", "2024-01-12")).select("doc_id")


@query("""WITH u AS (SELECT event_id, CAST(event_id % 30 AS DOUBLE) AS n, ['s', 'min', 'h', 'd', 'w', 'mo', 'y', 'xyz'][CAST(event_id % 8 AS INT) + 1] AS unit FROM events)
SELECT event_id, round(CASE unit WHEN 's' THEN n / 86400 WHEN 'min' THEN n / 1440 WHEN 'h' THEN n / 24 WHEN 'd' THEN n WHEN 'w' THEN n * 7 WHEN 'mo' THEN n * 30 WHEN 'y' THEN n * 365 END, 6) AS days FROM u""")
def dt_rel_age(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, ["s", "min", "h", "d", "w", "mo", "y", "xyz"])), (F.col("event_id") % 8 + 1).cast("int"))
    return views.read(spark, sf, "events").select("event_id", F.round(dates.relative_age_days(F.concat((F.col("event_id") % 30).cast("string"), unit)), 6).alias("days"))


@query(f"""WITH {A}, h AS (SELECT doc_id, published_at, CASE WHEN published_at = '' THEN NULL ELSE (1706745600 - epoch(CAST(left(published_at, 19) AS TIMESTAMP))) / 3600.0 END AS h FROM articles),
w AS (SELECT doc_id, published_at, floor(h + 0.5) AS h, floor(floor(h + 0.5) / 24 + 0.5) AS d FROM h)
SELECT doc_id, CASE WHEN h IS NULL THEN published_at WHEN h < 1 THEN 'just now' WHEN h < 24 THEN CAST(CAST(h AS BIGINT) AS VARCHAR) || 'h ago' WHEN d < 7 THEN CAST(CAST(d AS BIGINT) AS VARCHAR) || 'd ago' ELSE strftime(CAST(left(published_at, 19) AS TIMESTAMP), '%-d %b %Y') END AS shown FROM w""")
def dt_rel_display(spark, sf):
    return views.articles(spark, sf).select("doc_id", dates.relative_display(F.col("published_at"), F.expr(AS_OF)).alias("shown"))


_PAYLOADS = ['{"summary": "  s ", "relevant": "no", "event_type": "Evento", "alert_level": "Alto", "title": "t"}', 'text {"summary": "x", "relevant": 0} end', "[1, 2]", '{"summary": " "}', '{"summary": "y", "event_type": "Other", "relevant": "maybe", "competitor_analysis": 5}', "nothing"]
_WANT = [("s", "", "t", "Evento", "Alto", False, None), ("x", "", "", "Atualizacao", "Baixo", False, None), (None,) * 6 + ("invalid json",), (None,) * 6 + ("missing summary",), ("y", "", "", "Atualizacao", "Baixo", True, None), (None,) * 6 + ("invalid json",)]
_ROWS = ", ".join(f"({i}, {', '.join('NULL' if x is None else str(x).lower() if isinstance(x, bool) else repr(x) for x in w)})" for i, w in enumerate(_WANT))


@query(f"SELECT c.conv_id, c.turn, w.summary, w.competitor_analysis, w.title, w.event_type, w.alert_level, w.relevant, w.error FROM conversations c JOIN (VALUES {_ROWS}) AS w(k, summary, competitor_analysis, title, event_type, alert_level, relevant, error) ON (c.conv_id + c.turn) % {len(_PAYLOADS)} = w.k")
def js_normalize(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, _PAYLOADS)), ((F.col("conv_id") + F.col("turn")) % len(_PAYLOADS) + 1).cast("int"))
    return views.read(spark, sf, "conversations").select("conv_id", "turn", payloads.normalized_summary(raw).alias("v")).select("conv_id", "turn", "v.*")


@query("SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'related' ELSE 'different' END AS verdict FROM conversations")
def js_verdict(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, [" **Same.** different", "I think: related!", "no idea", "Different, not same"])), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    return views.read(spark, sf, "conversations").select("conv_id", "turn", payloads.verdict(raw).alias("verdict"))


@query("SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) <> '' AS titled, regexp_extract(html, '<img[^>]+src=[\"'']([^\"'']+)[\"'']', 1) AS image FROM pages")
def fn_page_image(spark, sf):
    p = views.read(spark, sf, "pages")
    return p.select("page_id", (readers.title_of(F.col("html")) != "").alias("titled"), text.page_image(F.col("html"), F.lit(200)).alias("image"))


# Sources and sinks ---------------------------------------------------------------------------------

_CATALOG = """
sources:
  - {source_id: a, name: Alpha, rss_url: 'https://a.example/feed', tag: T1}
  - {source_id: b, name: Beta, query_text: 'brake pads', tag: T2}
  - {source_id: c, name: Gamma, feed_type: linkedin_company, query_text: gamma, active: false}
  - {source_id: d, name: Delta, tag: ''}
"""


@query("""SELECT event_id, CAST(p AS BIGINT) AS pos, 'Item ' || p || ' - Paper' AS title, 'https://x.example/' || event_id || '/' || p AS link, 'Paper' AS publisher, 'a & b' AS summary_text,
strftime(TIMESTAMP '2024-03-05 06:07:08' + to_hours(CAST(event_id % 100 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS published FROM events, (VALUES (0), (1)) AS v(p)""")
def src_rss(spark, sf):
    when = F.date_format(F.expr("timestamp_ntz'2024-03-05 06:07:08' + make_dt_interval(0, cast(event_id % 100 as int))"), "dd MMM yyyy HH:mm:ss")

    def entry(i: int):
        return F.concat(F.lit(f"<item><title>Item {i} - Paper</title><link>https://x.example/"), F.col("event_id").cast("string"), F.lit(f"/{i}</link><pubDate>Tue, "), when, F.lit(" GMT</pubDate><description>&lt;b&gt;a&lt;/b&gt; &amp;amp; b</description></item>"))

    body = F.concat(F.lit("<rss><channel>"), entry(0), entry(1), F.lit("<item><title>no link</title></item></channel></rss>"))
    rows = readers.rss_items(views.read(spark, sf, "events").select("event_id", body.alias("body")))
    return rows.select("event_id", F.col("pos").cast("long").alias("pos"), "title", "link", "publisher", "summary_text", F.date_format(F.to_utc_timestamp("published", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("published"))


@query(f"WITH {A} SELECT article_hash, '---' || E'\\nid_hash: ' || article_hash || E'\\nsource: ' || source_id || E'\\ncategory: ' || category || E'\\ntag: ' || tag || E'\\nproduct_line: \\nevent_type: \\nalert_level: \\ndate: ' || published_at || E'\\nimage_url: \\nurl: ' || link || E'\\n---\\n\\n# ' || title || E'\\n\\nURL: ' || link || E'\\n\\n' || action_description AS content, 'out/run1/' || source_id || '/' || source_id || '_' || left(article_hash, 8) || '.md' AS key FROM articles")
def snk_markdown(spark, sf):
    rows = writers.with_keys(writers.markdown(views.articles(spark, sf), "action_description"), "out/", "run1")
    return rows.select("article_hash", "content", "key")


_JSON_OF = {"article_hash", "source_id", "source_name", "category", "tag", "published_at", "link", "title"}
_JSON = ", ".join(f"'{k}': {f'coalesce({c}, {chr(39) * 2})' if c in _JSON_OF else chr(39) * 2}" for k in writers.SUMMARY for c in [dict(writers.FRONT).get(k, k)])


@query(f"WITH {A} SELECT article_hash, source_id || '_' || left(article_hash, 8) AS slug, CAST(to_json({{{_JSON}}}) AS VARCHAR) AS content FROM articles")
def snk_summary_json(spark, sf):
    return writers.summary_json(views.articles(spark, sf)).select("article_hash", "slug", "content")


@query("SELECT event_id, 'S' || event_id % 7 AS symbol, 'Company ' || event_id % 7 AS company, round(CAST(event_id % 100 AS DOUBLE) + 0.25, 4) AS price, -1.5 AS change_percent FROM events".replace("-1.5 AS", "CAST(-1.5 AS DOUBLE) AS"))
def src_stocks_api(spark, sf):
    wanted = spark.range(0, 7).selectExpr("concat('S', id) as symbol", "concat('Company ', id) as company")
    payload = F.expr("""concat('{"S', event_id % 7, '": {"symbol": "S', event_id % 7, '", "close": "', event_id % 100, '.25", "percent_change": "-1.5"}, "BAD": {"status": "error"}, "S0X": {"symbol": "S0X", "close": "n/a"}}')""")
    events = views.read(spark, sf, "events").select("event_id", payload.alias("payload"))
    joined = readers.quotes(events.withColumn("payload", F.col("payload")), wanted)
    ids = events.select("event_id", F.concat(F.lit("S"), (F.col("event_id") % 7).cast("string")).alias("symbol"), (F.col("event_id") % 100 + 0.25).alias("price"))
    return ids.join(joined.distinct(), ["symbol", "price"]).select("event_id", "symbol", "company", "price", "change_percent")


@query("SELECT event_id, CAST(event_id % 90 + 10 AS DOUBLE) + 0.65 AS price, CAST(-0.48 AS DOUBLE) AS change_percent FROM events")
def stk_quote(spark, sf):
    html = F.concat(F.lit("<script>1,00 EUR -1,00 EUR -1,00 %</script><p>9,99 SEK +1,00 SEK +2,00 %</p><b>"), (F.col("event_id") % 90 + 10).cast("string"), F.lit(",65 EUR -0,07 EUR -0,48 %</b>"))
    return views.read(spark, sf, "events").select("event_id", social.quote(html, "EUR").alias("q")).select("event_id", "q.*")


# Streams -------------------------------------------------------------------------------------------


def _stream(spark, sf):
    schema = views.read(spark, sf, "events").schema
    return jobs.read_events(spark, f"{sf}/events*.parquet", schema)


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def st_window(spark, sf):
    out = jobs.drained(jobs.windowed_counts(_stream(spark, sf), "event_type"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT DISTINCT user_id FROM events")
def st_late_dedup(spark, sf):
    return jobs.drained(jobs.first_seen(_stream(spark, sf), ["user_id"], "365 days")).select("user_id")


_BREAKER = f"""WITH {FE}, i AS (SELECT *, sum(CASE WHEN status < 400 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY "at", id) AS island FROM fetches),
f AS (SELECT *, sum(CASE WHEN status >= 400 THEN 1 ELSE 0 END) OVER (PARTITION BY host, island ORDER BY "at", id) AS failures FROM i),
t AS (SELECT *, CASE WHEN status >= 400 AND (status IN (403, 429, 503, 999) OR failures >= 3) THEN "at" + CASE WHEN retry_after IS NULL THEN 60.0 ELSE greatest(least(retry_after, 300.0), 1.0) END END AS trip FROM f)
SELECT host, id, CAST(failures AS BIGINT) AS failures, coalesce(last_value(trip IGNORE NULLS) OVER (PARTITION BY host, island ORDER BY "at", id), 0.0) AS blocked_until FROM t"""


@query(_BREAKER)
def st_breaker(spark, sf):
    return jobs.breaker_batch(views.fetches(spark, sf))


@query(_BREAKER)
def st_breaker_stream(spark, sf):
    """The stateful stream over the same responses; no host is forgotten in the time that they take."""
    spark = keyed_state.session_with_state(spark)
    events = spark.readStream.schema(views.read(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    rows = events.selectExpr(
        "cast(user_id as string) as host", "event_id as id", "1e9 + event_id as at",
        "cast(case when event_type in ('error', 'view') then case when value > 30 then 503 else 500 end else 200 end as int) as status",
        "case when event_id % 9 = 0 then cast(event_id % 400 as double) end as retry_after",
    )
    out = jobs.drained(keyed_state.breaker(rows, 1e9))  # a stream's rows at the very epoch count as late
    return out.withColumn("blocked_until", F.when(F.col("blocked_until") > 0, F.col("blocked_until") - 1e9).otherwise(0.0))


from tidewire.plans import keeping, running, serving, showing  # noqa: E402,F401  register their queries here
