"""Queries of whole stage runs over a store that they fill from the given tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewire.plans import views
from tidewire.plans.catalog import A, _LOOKUP, _SCOPE, query
from tidewire.plans.keeping import _new_folder, _rolling
from tidewire.plans.stages import ArticleRuns
from tidewire.sources import readers

_WHY = f"""CASE WHEN coalesce(raw_link, '') = '' THEN 'unresolved' WHEN regexp_matches(published_at, 'T.*(Z|[+-]\\d\\d:?\\d\\d)$') AND published_at < '2024-01-08' THEN 'cutoff'
WHEN regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '{_SCOPE}') THEN 'scope' END"""
#: Items of the articles with their whole texts, and why one is dropped whatever is known.
_ITEMS = f"{A}, items AS (SELECT a.doc_id, a.source_id, a.raw_link, coalesce(a.title, '') AS title, a.published_at, coalesce(d.text, '') AS text FROM articles a JOIN documents d ON a.doc_id = d.doc_id WHERE a.source_id IS NOT NULL), sifted AS (SELECT *, {_WHY} AS why FROM items)"


def _items(spark, sf):
    rows = views.articles(spark, sf, labelled=False)
    return rows.select("doc_id", "source_id", F.col("doc_id").alias("pos"), "title", F.col("raw_link").alias("link"), "published_at", F.col("text").alias("summary_text"), F.lit("").alias("image_url"))


def _sources(spark, sf):
    """A source for each of the documents'; those that end in 3 are of no category that waits."""
    own = views.read(spark, sf, "documents").select("source").distinct().where("source is not null")
    return readers.with_defaults(own.selectExpr("source source_id", "upper(source) name", "concat('https://', source, '.example.com/feed') rss_url", "case when source like '%3' then 'outros' else 'auto' end category"))


def _cutoff():
    return F.to_timestamp(F.lit("2024-01-08T00:00:00Z"))


@query(f"""WITH {_ITEMS}, old AS (SELECT DISTINCT raw_link FROM sifted WHERE why IS NULL AND doc_id % 3 <> 0),
met AS (SELECT s.*, coalesce(s.why, CASE WHEN o.raw_link IS NOT NULL THEN 'raw_dedup' END) AS seen FROM sifted s LEFT JOIN old o ON s.raw_link = o.raw_link),
told AS (SELECT *, CASE WHEN seen IS NOT NULL THEN seen WHEN row_number() OVER (PARTITION BY raw_link, seen IS NULL ORDER BY source_id, doc_id) > 1 THEN 'hash_dedup' END AS reason FROM met)
SELECT source_id, count(*) AS found, count(*) FILTER (reason = 'cutoff') AS dropped_cutoff, count(*) FILTER (reason = 'scope') AS dropped_scope, count(*) FILTER (reason = 'raw_dedup') AS dropped_raw_dedup,
count(*) FILTER (reason = 'hash_dedup') AS dropped_hash_dedup, count(*) FILTER (reason = 'unresolved') AS dropped_unresolved, count(*) FILTER (reason IS NULL) AS "new", count(*) FILTER (reason IN ('raw_dedup', 'hash_dedup')) AS duplicate FROM told GROUP BY source_id""")
def cli_collect(spark, sf):
    """All articles once two thirds of them are stored: what each source's items come to."""
    runs, items, sources = ArticleRuns(spark, _new_folder(spark, "runs"), 16, 1 << 10), _items(spark, sf), _sources(spark, sf)
    runs.collect(items.where("doc_id % 3 <> 0"), sources, "2024-01-30T00:00:00Z", _cutoff()).drop()
    return runs.collect(items, sources, "2024-01-31T00:00:00Z", _cutoff()).rows


def _answer(prompt: str) -> str:
    """A stand-in for a model whose answer hangs on the prompt's length."""
    if len(prompt) % 4 == 0:
        raise ValueError("refused")
    return json.dumps({"summary": "read", "relevant": len(prompt) % 4 != 1})


_DAYS = ("2024-01-10", "2024-01-11", "2024-01-15")
_TIMES = ", ".join(f"epoch_us(TIMESTAMP '{d} 00:00:00')" for d in _DAYS)


@query(f"""WITH RECURSIVE {_ITEMS}, firsts AS (SELECT *, doc_id % 3 AS part, md5(raw_link) AS article_hash, row_number() OVER (PARTITION BY raw_link ORDER BY doc_id % 3, source_id, doc_id) AS n FROM sifted WHERE why IS NULL),
k AS (SELECT article_hash, source_id, title, [{_TIMES}][CAST(part AS INT) + 1] AS ts, {_LOOKUP} AS key, NOT source_id LIKE '%3' AS queued, (18 + length(title) + length(left(text, 300))) % 4 AS said FROM firsts WHERE n = 1),
r AS (SELECT key, ts, article_hash AS id FROM k WHERE queued), f AS (SELECT key, ts, article_hash AS id FROM k WHERE NOT queued), {_rolling('r', 72, 'f')}
SELECT k.article_hash, k.source_id, CASE WHEN NOT queued THEN '' WHEN match IS NULL THEN 'new' ELSE 'duplicate' END AS dedup_decision, match AS dedup_match_hash,
CASE WHEN NOT queued OR match IS NOT NULL OR said = 0 THEN 'pending' WHEN said = 1 THEN 'irrelevant' ELSE 'ai_generated' END AS summary_status,
CASE WHEN queued AND match IS NULL AND said = 0 THEN 'refused' ELSE '' END AS extra FROM k LEFT JOIN decided ON id = k.article_hash""")
def cli_run(spark, sf):
    """Three collections on three days, then one run of dedup, summaries and retries: every article as it stands."""
    runs, items, sources = ArticleRuns(spark, _new_folder(spark, "runs"), 16, 1 << 10), _items(spark, sf), _sources(spark, sf)
    for part, day in enumerate(_DAYS):
        runs.collect(items.where(F.col("doc_id") % 3 == part), sources, f"{day}T00:00:00Z", _cutoff()).drop()
    runs.dedup()
    runs.summarize(_answer, "2024-01-15T01:00:00Z")
    runs.retry()
    return runs.articles.select("article_hash", "source_id", "dedup_decision", "dedup_match_hash", "summary_status", "extra")
