"""Queries of what is kept: the store by key, the first of a title for a while, the pending run, the cascade by batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewire.functions import payloads
from tidewire.operators import answers, cascade, dedup, laid_out, similarity, store, text_search
from tidewire.operators.anchors import first_for_a_while
from tidewire.operators.keyed import KeyedStore
from tidewire.plans import views
from tidewire.plans.catalog import A, I, _LOOKUP, _TWO, query
from tidewire.plans.storage import gone_at_exit, shared_folder
from tidewire.streaming import jobs, keyed_state


def _new_folder(spark, name: str) -> str:
    """A folder that goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    gone_at_exit(spark, path)
    return path


@query(f"""WITH {A}, r AS (SELECT md5(raw_link) AS article_hash, doc_id, title, source_id, doc_id % 4 AS batch FROM articles)
SELECT article_hash, arg_min(doc_id, (batch, doc_id)) AS doc_id, arg_min(title, (batch, doc_id)) AS title, arg_min(source_id, (batch, doc_id)) AS source_id FROM r GROUP BY article_hash""")
def snk_store(spark, sf):
    """Every article in four batches, the second one twice, into a store by the hash of its link."""
    rows = views.articles(spark, sf).select(F.md5("raw_link").alias("article_hash"), "doc_id", "title", "source_id")
    kept = KeyedStore(spark, _new_folder(spark, "articles"), rows.schema, "article_hash", buckets=32, words=1 << 10)
    for batch in (0, 1, 1, 2, 3):
        kept.add(rows.where(F.col("doc_id") % 4 == batch), ["doc_id"])
    return kept.rows.select("article_hash", "doc_id", "title", "source_id")


def _rolling(rows: str, hours: float, fixed: str = "") -> str:
    """SQL of the kept rows of `rows` (key, ts, id), followed one by one, and of what hides the others."""
    span = int(hours * 3_600_000_000)
    cover = f"(SELECT max(f.id) FROM {fixed} f WHERE f.key = p.key AND f.ts = (SELECT max(g.ts) FROM {fixed} g WHERE g.key = p.key AND g.ts <= p.ts AND g.ts >= p.ts - {span}))" if fixed else "NULL"
    return f"""covered AS (SELECT p.key, p.ts, p.id, {cover} AS hid FROM {rows} p),
opened AS (SELECT key, ts, min(id) AS id FROM covered WHERE hid IS NULL GROUP BY ALL),
chain AS (SELECT key, min(ts) AS ts FROM opened GROUP BY key UNION ALL SELECT key, ts FROM (SELECT c.key, (SELECT min(o.ts) FROM opened o WHERE o.key = c.key AND o.ts > c.ts + {span}) AS ts FROM chain c) WHERE ts IS NOT NULL),
kept AS (SELECT c.key, c.ts, o.id FROM chain c JOIN opened o ON o.key = c.key AND o.ts = c.ts),
found AS (SELECT p.key, p.ts, p.id, coalesce(p.hid, max_by(k.id, k.ts)) AS match FROM covered p LEFT JOIN kept k ON k.key = p.key AND k.ts <= p.ts AND k.ts >= p.ts - {span} AND k.id <> p.id GROUP BY p.key, p.ts, p.id, p.hid),
decided AS (SELECT f.id, CASE WHEN s.id IS NULL THEN f.match END AS match FROM found f LEFT JOIN kept s ON s.id = f.id)"""


_AT = "epoch_us(CAST(replace(replace(collected_at, 'T', ' '), 'Z', '') AS TIMESTAMP))"


@query(f"""WITH RECURSIVE {A}, r AS (SELECT {_LOOKUP} AS key, {_AT} AS ts, article_hash AS id FROM articles), {_rolling('r', 72)}
SELECT id AS article_hash, CASE WHEN match IS NULL THEN 'new' ELSE 'duplicate' END AS dedup_decision, match AS dedup_match FROM decided""")
def dd2_rolling(spark, sf):
    return dedup.rolling_titles(views.articles(spark, sf))


@query(f"""WITH RECURSIVE {A}, r AS (SELECT source_id AS key, {_AT} AS ts, article_hash AS id FROM articles), {_rolling('r', 5)} SELECT id AS article_hash, match FROM decided""")
def dd2_rolling_source(spark, sf):
    """One article of a source for five hours: long chains, and a hot key."""
    at = F.unix_micros(F.try_to_timestamp("collected_at"))
    rows = views.articles(spark, sf).select(F.col("source_id").alias("key"), at.alias("at"), F.col("article_hash").alias("id"))
    return first_for_a_while(rows, 5 * 3_600_000_000).select(F.col("id").alias("article_hash"), "match")


_QUEUE = "summary_status = 'pending' AND category IN ('auto', 'economia', 'tecnologia') AND dedup_decision IS DISTINCT FROM 'duplicate'"


@query(f"""WITH RECURSIVE {A}, k AS (SELECT *, {_LOOKUP} AS key, {_AT} AS ts, coalesce({_QUEUE}, false) AS queued FROM articles),
r AS (SELECT key, ts, article_hash AS id FROM k WHERE queued),
f AS (SELECT key, ts, article_hash AS id FROM k WHERE NOT queued AND summary_status IS DISTINCT FROM 'irrelevant' AND dedup_decision IS DISTINCT FROM 'duplicate'), {_rolling('r', 72, 'f')}
SELECT id AS article_hash, CASE WHEN match IS NULL THEN 'new' ELSE 'duplicate' END AS dedup_decision, CASE WHEN match IS NOT NULL THEN 1 END AS dedup_layer,
CASE WHEN match IS NOT NULL THEN 'same_title' END AS dedup_reason, match AS dedup_match_hash, CAST(NULL AS DOUBLE) AS dedup_score FROM decided""")
def dd2_run(spark, sf):
    """The pending queue, with what is decided already standing."""
    return dedup.run_pending(views.articles(spark, sf))


@query()
def dd5_batches(spark, sf):
    """The items and their vectors through the cascade in four batches, with windows of two, one and two hours; held against a scan of one row after the other in the tests."""
    vectors = views.read(spark, sf, "embeddings").select(F.col("vec_id").alias("rowid"), "embedding")
    items = views.items(spark, sf).drop("status", "summarized_at")
    last = items.agg(F.max("rowid")).first()[0]
    decided = cascade.Decisions(spark, _new_folder(spark, "decisions"), (2, 1, 2), buckets=16)
    for batch in range(4):
        some = items.where(F.floor(F.col("rowid") * 4 / (last + 1)) == batch)
        decided.feed(some.join(vectors.hint("merge"), "rowid", "left"), some.agg(F.max("created_at")).first()[0])
    return decided.items.select("rowid", "status", "layer")


@query(f"""WITH {A}, p AS (SELECT article_hash, title, sort_key, row_number() OVER (ORDER BY sort_key DESC) AS n FROM pub WHERE coalesce(content_kind, 'news') = 'news')
SELECT CAST(page AS INTEGER) AS page, article_hash, title, sort_key FROM p, (VALUES (0), (3)) v(page) WHERE n > 20 * page AND n <= 20 * page + 20""")
def pag_laid_out(spark, sf):
    """The first and the fourth page of news, out of the slots that hold them."""
    laid = laid_out.lay_out(views.articles(spark, sf), _new_folder(spark, "feed"), 100)
    cursor, pages = None, []
    for n in range(4):
        page, cursor = laid.page(20, "news", cursor)
        if n in (0, 3):
            pages.append(page.select(F.lit(n).alias("page"), "article_hash", "title", "sort_key"))
    return pages[0].union(pages[1])


@query(f"WITH {A} SELECT article_hash, company, sort_key FROM (SELECT article_hash, sort_key, {_TWO} AS company FROM pub) WHERE company IS NOT NULL ORDER BY sort_key DESC LIMIT 30")
def pag_laid_out_companies(spark, sf):
    """The newest rows of two companies out of the copy by company, each under the first asked for."""
    laid = laid_out.lay_out(views.articles(spark, sf), _new_folder(spark, "feed"), 100)
    page, _ = laid.page(30, names=["src0", "src1"])
    return page.select("article_hash", F.col("companies")[0].alias("company"), "sort_key")


@query(f"""WITH RECURSIVE {I}, r AS (SELECT title_hash AS key, CAST(created_at * 1000000 AS BIGINT) AS ts, lpad(CAST(rowid AS VARCHAR), 9, '0') AS id FROM items), {_rolling('r', 1)}
SELECT CAST(id AS BIGINT) AS rowid, CASE WHEN match IS NULL THEN 'new' ELSE 'dupe' END AS status, CAST(match AS BIGINT) AS match FROM decided""")
def st_titles_stream(spark, sf):
    """The items as a stream whose titles are held for an hour."""
    own = keyed_state.session_with_state(spark)
    docs = own.readStream.schema(views.read(spark, sf, "documents").schema).parquet(f"{sf}/documents*.parquet")
    rows = docs.selectExpr("doc_id as rowid", "md5(lower(trim(substring(substring_index(text, '\\n', 1), 1, 120)))) as title_hash", "cast(1704067200 + doc_id * 60 as double) as created_at")
    return jobs.drained(keyed_state.first_titles(rows, 1)).select("rowid", "status", "match")


@query(f"""WITH {A}, k AS (SELECT DISTINCT raw_link AS link, CAST(regexp_extract(raw_link, '([0-9]+)$', 1) AS INTEGER) % 4 AS n FROM articles)
SELECT 'https://news.google.com/?u=' || link AS link, CASE WHEN n < 3 THEN link END AS resolved_link, CASE WHEN n < 3 THEN 'ok' ELSE 'failed' END AS resolve_status, CASE WHEN n < 3 THEN n + 1 ELSE 3 END AS resolve_attempts FROM k""")
def udf_resolve(spark, sf):
    """Every link behind a wrapper, over four runs; a stand-in lets a link pass in the run after its number. The run before a link is due asks for nothing."""
    links = views.articles(spark, sf).select(F.concat(F.lit("https://news.google.com/?u="), "raw_link").alias("link")).distinct()
    kept = answers.Answers(spark, _new_folder(spark, "answers"), attempts=3, base=60.0)

    def standing_in(run: int):
        def resolve(url: str) -> str:
            n = int(url.rsplit("/", 1)[1]) % 4
            return url.split("?u=")[1] if n <= run else url

        return resolve

    for run, now in ((0, 0.0), (3, 59.0), (1, 60.0)):
        answers.resolved(links, kept, standing_in(run), now)
    return answers.resolved(links, kept, standing_in(2), 180.0).select("link", "resolved_link", "resolve_status", "resolve_attempts")


@query("""WITH e AS (SELECT *, event_id % 10 = 0 AS late FROM events), m AS (SELECT max(ts) FILTER (WHERE event_id % 10 > 1) AS before, max(ts) AS last FROM e),
k AS (SELECT date_trunc('hour', ts) AS s, event_type, value, late FROM e)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM k, m
WHERE (NOT late OR s + INTERVAL 1 HOUR > before - INTERVAL 6 HOUR) AND s + INTERVAL 1 HOUR <= last - INTERVAL 6 HOUR GROUP BY ALL""")
def st_late(spark, sf):
    """Windows of an hour with a watermark of six: a tenth of the events comes two triggers after most others, and what of it is late by then is dropped (Spark drops by the watermark of the trigger before). Windows beyond the last watermark are not told yet."""
    folder = _new_folder(spark, "events")
    events = views.read(spark, sf, "events")
    for part in ("event_id % 10 > 1", "event_id % 10 = 1", "event_id % 10 = 0"):
        events.where(part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.drained(jobs.windowed_counts(stream, "event_type", late="6 hours"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(r"""WITH c AS (SELECT conv_id, turn, trim(text, E' \n\t\r') AS t, (conv_id + turn) % 5 AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN k < 3 AND t <> '' THEN left(t, 900) END AS summary, CASE WHEN k < 3 AND t <> '' THEN k <> 1 END AS relevant, CASE WHEN k >= 3 THEN 'invalid json' WHEN t = '' THEN 'missing summary' END AS error FROM c""")
def js_payloads(spark, sf):
    """Answers that hold each turn's whole text: bare, irrelevant and fenced, with words around, cut off, and as an array."""
    said = "to_json(named_struct('summary', text, 'relevant', case when (conv_id + turn) % 5 = 1 then 'no' else 'yes' end))"
    raw = F.expr(f"case (conv_id + turn) % 5 when 0 then {said} when 1 then concat('```json\\n', {said}, '\\n```') when 2 then concat('As asked: ', {said}, ' .') when 3 then substring({said}, 1, length({said}) - 2) else concat('[', {said}, ']') end")
    return views.read(spark, sf, "conversations").select("conv_id", "turn", payloads.normalized_summary(raw).alias("v")).select("conv_id", "turn", "v.summary", "v.relevant", "v.error")


_BM25 = r"""w AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)'), lambda x: length(x) > 1) AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w), p AS (SELECT id, len(w) AS length, unnest(w) AS term FROM w), tf AS (SELECT id, length, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT doc_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(left(split_part(text, chr(10), 1), 120)), '([\p{L}\p{N}_]+)'), lambda x: length(x) > 1))) AS term FROM documents WHERE doc_id % 100 = 0),
b AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b)"""


def _searched(spark, sf, k: int):
    """Documents by the words of the first lines of those whose id is divisible by 100."""
    docs = views.read(spark, sf, "documents")
    first = F.substring(F.substring_index("text", "\n", 1), 1, 120)
    held = text_search.index(docs)
    out = text_search.search(held, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), text_search.words(first).alias("terms")), k)
    held.drop()
    return out


@query(f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def jn_fts(spark, sf):
    return _searched(spark, sf, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_BM25}, c AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS cosine FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS n FROM c),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, coalesce(0.6 / a.n, 0) + coalesce(0.4 / b.rank, 0) AS score, coalesce(a.cosine, 0) AS cosine FROM (SELECT * FROM cr WHERE n <= 20) a FULL JOIN (SELECT * FROM r WHERE rank <= 10) b ON a.query_id = b.query_id AND a.id = b.id),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM f)
SELECT query_id, id, round(score, 9) AS score, round(CAST(cosine AS DOUBLE), 6) AS cosine FROM z WHERE n <= 10""")
def dd_hybrid(spark, sf):
    """Vectors and words of the stated queries, fused by reciprocal ranks: twice as many by vectors as are asked for."""
    v = views.read(spark, sf, "embeddings")
    knn = similarity.top_cosine(v.where("vec_id % 100 = 0"), v, 20).select("query_id", F.col("vec_id").alias("id"), F.col("score").alias("cosine"), "rank")
    return text_search.fused(knn, _searched(spark, sf, 10), 10).select("query_id", "id", F.round("score", 9).alias("score"), F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {A} SELECT a.article_hash, CASE WHEN l.toxic = 1 THEN 'irrelevant' ELSE 'failed' END AS summary_status, CASE WHEN l.toxic = 1 THEN NULL ELSE 'quality of ' || l.doc_id END AS extra
FROM articles a JOIN labels l ON l.doc_id = a.doc_id WHERE l.toxic = 1 OR l.quality = 0""")
def snk_marks(spark, sf):
    """What labels say of articles as marks: toxic ones are irrelevant, poor ones failed."""
    marks = views.read(spark, sf, "labels").selectExpr("md5(cast(doc_id as string)) article_hash", "case when toxic = 1 then 'irrelevant' when quality = 0 then 'failed' end status", "concat('quality of ', doc_id) error")
    return store.marked(views.articles(spark, sf), marks, 2).select("article_hash", "summary_status", "extra")
