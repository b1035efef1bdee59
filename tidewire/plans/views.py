"""Domain tables derived from the star-schema test tables, in Spark and in SQL alike.

Text stays within ASCII white space and lower-casing that Java and DuckDB share; times are literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hours(column: str, extra: str = "0") -> str:
    return f"date_format(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast({column} % 720 + {extra} as int)), \"yyyy-MM-dd'T'HH:mm:ss\")"


def articles(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """Documents with their labels as articles: three shapes of dates, three queues, two companies now and then. Not labelled: without a status, and with their texts."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if labelled:
        rows = rows.join(read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    status = "case when toxic = 1 then 'irrelevant' when quality = 0 then 'failed' when quality = 1 then 'ai_generated' when doc_id % 23 = 4 then cast(null as string) else 'pending' end as summary_status"
    return rows.selectExpr(
        "doc_id", "md5(cast(doc_id as string)) as article_hash", "substring(substring_index(text, '\\n', 1), 1, 120) as title",
        "substring(text, 1, 300) as action_description", "source as source_id", "upper(source) as source_name",
        "concat('https://', source, '.example.com/', lang, '/', cast(doc_id % 700 as string)) as raw_link",
        "concat('https://', source, '.Example.com/', lang, '/', cast(doc_id % 700 as string), case when doc_id % 3 = 0 then '/#top' else '' end) as link",
        f"case when doc_id % 50 = 7 then '' when doc_id % 3 = 0 then substring({_hours('doc_id')}, 1, 10) when doc_id % 3 = 1 then {_hours('doc_id')} else concat({_hours('doc_id')}, '+00:00') end as published_at",
        f"concat({_hours('doc_id', 'doc_id % 5')}, 'Z') as collected_at",
        "case lang when 'en' then 'auto' when 'fr' then 'economia' when 'de' then 'tecnologia' else 'outros' end as category",
        "case when doc_id % 4 = 0 then 'social' when doc_id % 11 = 5 then cast(null as string) else 'news' end as content_kind",
        "case when doc_id % 4 = 0 then 'linkedin_company' else 'rss_direct' end as feed_type",
        "case when doc_id % 10 = 0 then concat(source, ', src', cast(doc_id % 20 as string)) when doc_id % 17 = 3 then '' else source end as tag",
        status if labelled else "text",
        "case when doc_id % 13 = 0 then 'duplicate' when doc_id % 13 = 1 then 'new' when doc_id % 13 = 2 then cast(null as string) else '' end as dedup_decision",
        "md5(lower(trim(substring(substring_index(text, '\\n', 1), 1, 120)))) as title_hash",
    )


_SQL_HOURS = "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST({0} AS BIGINT)), '%Y-%m-%dT%H:%M:%S')"
_PUB, _COL = _SQL_HOURS.format("d.doc_id % 720"), _SQL_HOURS.format("d.doc_id % 720 + d.doc_id % 5")
ARTICLES_SQL = f"""articles AS (SELECT d.doc_id, md5(CAST(d.doc_id AS VARCHAR)) AS article_hash, left(split_part(d.text, chr(10), 1), 120) AS title,
  left(d.text, 300) AS action_description, d.source AS source_id, upper(d.source) AS source_name,
  'https://' || d.source || '.example.com/' || d.lang || '/' || CAST(d.doc_id % 700 AS VARCHAR) AS raw_link,
  'https://' || d.source || '.Example.com/' || d.lang || '/' || CAST(d.doc_id % 700 AS VARCHAR) || CASE WHEN d.doc_id % 3 = 0 THEN '/#top' ELSE '' END AS link,
  CASE WHEN d.doc_id % 50 = 7 THEN '' WHEN d.doc_id % 3 = 0 THEN left({_PUB}, 10) WHEN d.doc_id % 3 = 1 THEN {_PUB} ELSE {_PUB} || '+00:00' END AS published_at,
  {_COL} || 'Z' AS collected_at,
  CASE d.lang WHEN 'en' THEN 'auto' WHEN 'fr' THEN 'economia' WHEN 'de' THEN 'tecnologia' ELSE 'outros' END AS category,
  CASE WHEN d.doc_id % 4 = 0 THEN 'social' WHEN d.doc_id % 11 = 5 THEN NULL ELSE 'news' END AS content_kind,
  CASE WHEN d.doc_id % 4 = 0 THEN 'linkedin_company' ELSE 'rss_direct' END AS feed_type,
  CASE WHEN d.doc_id % 10 = 0 THEN d.source || ', src' || CAST(d.doc_id % 20 AS VARCHAR) WHEN d.doc_id % 17 = 3 THEN '' ELSE d.source END AS tag,
  CASE WHEN l.toxic = 1 THEN 'irrelevant' WHEN l.quality = 0 THEN 'failed' WHEN l.quality = 1 THEN 'ai_generated' WHEN d.doc_id % 23 = 4 THEN NULL ELSE 'pending' END AS summary_status,
  CASE WHEN d.doc_id % 13 = 0 THEN 'duplicate' WHEN d.doc_id % 13 = 1 THEN 'new' WHEN d.doc_id % 13 = 2 THEN NULL ELSE '' END AS dedup_decision,
  md5(lower(trim(left(split_part(d.text, chr(10), 1), 120)))) AS title_hash
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
keyed AS (SELECT *, coalesce(nullif(published_at, ''), collected_at) AS sort_ts, coalesce(nullif(published_at, ''), collected_at) || '#' || article_hash AS sort_key FROM articles),
pub AS (SELECT * FROM keyed WHERE summary_status IS DISTINCT FROM 'irrelevant' AND dedup_decision IS DISTINCT FROM 'duplicate'),
company AS (SELECT * FROM (SELECT article_hash, trim(unnest(string_split(tag, ','))) AS company, title, link, sort_ts AS published_at, category, content_kind, summary_status, dedup_decision, source_name FROM keyed) WHERE company <> '')"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of the layered store, in order of their id."""
    return read(spark, sf_dir, "documents").selectExpr(
        "doc_id as rowid", "md5(concat(source, '/', cast(doc_id % 900 as string))) as id_hash", "substring(substring_index(text, '\\n', 1), 1, 120) as title",
        "md5(lower(trim(substring(substring_index(text, '\\n', 1), 1, 120)))) as title_hash", "cast(1704067200 + doc_id * 60 as double) as created_at",
        "case when doc_id % 7 = 3 then 'dupe' else 'new' end as status", "case when doc_id % 5 = 2 then 1704067300.0D end as summarized_at",
    )


ITEMS_SQL = """items AS (SELECT doc_id AS rowid, md5(source || '/' || CAST(doc_id % 900 AS VARCHAR)) AS id_hash, left(split_part(text, chr(10), 1), 120) AS title,
  md5(lower(trim(left(split_part(text, chr(10), 1), 120)))) AS title_hash, CAST(1704067200 + doc_id * 60 AS DOUBLE) AS created_at,
  CASE WHEN doc_id % 7 = 3 THEN 'dupe' ELSE 'new' END AS status, CASE WHEN doc_id % 5 = 2 THEN CAST(1704067300 AS DOUBLE) END AS summarized_at FROM documents)"""


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feed items: the type is the source, some are undated."""
    return read(spark, sf_dir, "events").selectExpr("event_type as source", "event_id as pos", "case when event_id % 50 <> 0 then cast(ts as timestamp_ntz) end as published", "event_id", "user_id", "value")


FEED_SQL = "feed AS (SELECT event_type AS source, event_id AS pos, CASE WHEN event_id % 50 <> 0 THEN ts END AS published, event_id, user_id, value FROM events)"


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses of hosts: errors are refusals or failures."""
    return read(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as host", "event_id as id", "cast(event_id as double) as at",
        "cast(case when event_type in ('error', 'view') then case when value > 30 then 503 else 500 end else 200 end as int) as status",
        "case when event_id % 9 = 0 then cast(event_id % 400 as double) end as retry_after",
    )


FETCHES_SQL = """fetches AS (SELECT CAST(user_id AS VARCHAR) AS host, event_id AS id, CAST(event_id AS DOUBLE) AS "at",
  CASE WHEN event_type IN ('error', 'view') THEN CASE WHEN value > 30 THEN 503 ELSE 500 END ELSE 200 END AS status,
  CASE WHEN event_id % 9 = 0 THEN CAST(event_id % 400 AS DOUBLE) END AS retry_after FROM events)"""
