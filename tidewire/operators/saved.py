"""What readers keep: bookmarks and watch lists as toggles, the cache of recent articles, company names."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECENT = 50


def toggled(saved: DataFrame, toggles: DataFrame, clears: DataFrame | None = None) -> DataFrame:
    """user_id, article_hash, at after toggles (same columns) over what is saved; newest first by at.

    A toggle adds what is not there and removes what is, so an odd number of entries since the last clearing (user_id,
    at) stays, at the place of the last one. Partial aggregates: a busy user or article is no single task's.
    """
    events = saved.select("user_id", "article_hash", "at").unionByName(toggles.select("user_id", "article_hash", "at"))
    if clears is not None:
        last = clears.groupBy("user_id").agg(F.max("at").alias("cleared"))
        events = events.join(last, "user_id", "left").where("cleared is null or at > cleared").drop("cleared")
    counts = events.groupBy("user_id", "article_hash").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    return counts.where("n % 2 = 1").drop("n")


def bookmarked(articles: DataFrame, saved: DataFrame) -> DataFrame:
    return articles.join(saved.select("article_hash"), "article_hash", "left_semi")


def detail(wanted: DataFrame, cached: DataFrame, saved: DataFrame) -> DataFrame:
    """article_hash, title, origin of each wanted hash: from the cache, else the bookmarks, else null. Each of them holds a hash once."""
    out = wanted.select("article_hash").distinct()
    for name, rows in (("cache", cached), ("bookmark", saved)):
        out = out.join(rows.select("article_hash", F.struct("title", F.lit(name).alias("origin")).alias(name)), "article_hash", "left")
    found = F.coalesce("cache", "bookmark")
    return out.select("article_hash", found["title"].alias("title"), found["origin"].alias("origin"))


def recent(stashes: DataFrame, most: int = RECENT) -> DataFrame:
    """session, article_hash, at: what each session's cache holds after its stashes (session, article_hash, at).

    First in, first out: a hash stashed again while it is held keeps its place and takes the new `at`; one that has gone
    comes in anew. A session is read in order of (at, article_hash) and holds `most` entries at any time, however long it is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, held = None, OrderedDict()

        def left() -> pd.DataFrame:
            return pd.DataFrame([(session, h, at) for h, at in held.items()], columns=["session", "article_hash", "at"])

        for batch in batches:
            for s, h, at in batch.itertuples(index=False):
                if s != session:
                    if held:
                        yield left()
                    session, held = s, OrderedDict()
                held[h] = at
                if len(held) > most:
                    held.popitem(last=False)
        if held:
            yield left()

    rows = stashes.selectExpr("cast(session as string) session", "article_hash", "cast(at as double) at").where("session is not null and article_hash is not null")
    return rows.repartition("session").sortWithinPartitions("session", "at", "article_hash").mapInPandas(run, "session string, article_hash string, at double")


def all_quotes(first: DataFrame, second: DataFrame) -> DataFrame:
    """The quotes of two markets, repeats and all; what one of them lacks is null."""
    return first.unionByName(second, allowMissingColumns=True)


def company_list(names: DataFrame, name: str = "company") -> DataFrame:
    """The distinct names in a reader's order: accents and case come after letters."""
    return names.select(F.col(name).alias("company")).where("company is not null and company <> ''").distinct().orderBy(F.collate("company", "UNICODE"), "company")
