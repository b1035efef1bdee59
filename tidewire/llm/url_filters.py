"""URL filters by a temporal list join.

Dated list entries (list, pattern, action, effective, category) become validity intervals: at a time
the latest entry of a list and pattern holds, and an `add` lists it. A capture is judged against the
intervals open at its fetch time, for every domain suffix of its host. Hosts are joined once each, not
once for each capture, so a host with a third of all captures meets the lists once. What the lists say of
the hosts is then joined to the captures: broadcast while it has at most BROADCAST_SPANS intervals, else by
a shuffle that deals each host's captures to SALTS tasks.

Entries of one list and pattern with the same time: the last by action, then category (`remove` after
`add`), holds. Captures without a URL, host or time match nothing. Repeated captures and ids are judged
one by one. Extra columns of captures go through unless they have the name of a result column in any
case, which then wins. An empty list filters nothing; no captures give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import Stored, free_name, table

#: Fixed values of the query's list: names, suffixes with their turn, categories.
NAMES = (("spam-farm", "spam"), ("cheap-pills", "spam"), ("casino-win", "gambling"), ("free-bets", "gambling"), ("ads-track", "tracking"), ("adult-x", "adult"))
SUFFIXES = ("example.com", "example.net", "example.org")
START, HOUR, DAY = 1_704_067_200, 3600, 86_400  # 2024-01-01 00:00:00 UTC

#: Intervals of listed hosts that are broadcast, at most; beyond, captures and hosts meet by a salted shuffle.
BROADCAST_SPANS, SALTS = 1 << 18, 16

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """The lower-cased host without a final dot; null if there is none."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, HOST, 1), r"\.$", ""))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, category, since, until (exclusive; null: open): when each pattern was listed."""
    w = Window.partitionBy("list", "pattern").orderBy("effective", "action", "category")
    entries = entries.withColumn("pattern", F.lower("pattern"))
    return entries.withColumn("until", F.lead("effective").over(w)).where((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("effective")))).select("list", "pattern", "category", F.col("effective").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Captures with host, n_entries (active at the fetch time), categories (distinct, sorted, comma-joined) and blocked."""
    own = [c for c in captures.columns if c.lower() not in ("host", "n_entries", "categories", "blocked")]
    spans, salt = free_name(captures, "spans"), free_name(captures, "salt")
    captures = captures.select(*own, host_of(F.col(url_col)).alias("host"), F.col(time_col).alias(spans + "_at"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = captures.where("host is not null").select("host").distinct().select("host", F.explode(ends).alias("pattern"))
    listed = hosts.join(intervals(entries), "pattern").groupBy("host").agg(F.collect_list(F.struct("since", "until", "category")).alias(spans))
    listed = Stored(listed).rows
    if (listed.agg(F.sum(F.size(spans))).first()[0] or 0) <= BROADCAST_SPANS:
        out = captures.join(F.broadcast(listed), "host", "left")
    else:  # a host with a third of all captures is dealt to SALTS tasks
        salted = captures.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        out = salted.join(listed.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", salt], "left").drop(salt)
    t = F.col(spans + "_at")
    active = F.filter(F.coalesce(spans, F.array()), lambda s: (s["since"] <= t) & (s["until"].isNull() | (t < s["until"])))
    out = out.withColumn(spans, F.when(t.isNotNull(), active).otherwise(F.array()))
    categories = F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["category"]))), ",")
    return out.select(*own, "host", F.size(spans).cast("long").alias("n_entries"), categories.alias("categories"), (F.size(spans) > 0).alias("blocked"))


def query_entries(spark: SparkSession) -> DataFrame:
    """The query's dated list: each domain is added, the even ones are removed after eight days, and every third is added again as `repeat` ten days later."""
    rows = []
    for i, (name, category) in enumerate(NAMES):
        for j, suffix in enumerate(SUFFIXES):
            pattern, at = f"{name}.{suffix}", START + (3 * i + j) * DAY
            rows.append(("watch", pattern, "add", at, category))
            if (i + j) % 2 == 0:
                rows.append(("watch", pattern, "remove", at + 8 * DAY, category))
            if (i + j) % 3 == 0:
                rows.append(("watch", pattern, "add", at + 10 * DAY, "repeat"))
    return spark.createDataFrame(rows, "list string, pattern string, action string, effective long, category string")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures have no fetch time in the table: hour page_id mod 720 of January 2024 stands for it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.lit(START) + F.pmod("page_id", F.lit(720)) * HOUR).alias("fetched_at"))
    return judge(pages, query_entries(spark)).select("page_id", "host", "fetched_at", "n_entries", "categories", "blocked")


_NAME_ROWS = ", ".join(f"({i}, '{n}', '{c}')" for i, (n, c) in enumerate(NAMES))
_SUFFIX_ROWS = ", ".join(f"({j}, '{s}')" for j, s in enumerate(SUFFIXES))
SQL = f"""
WITH domains AS (
  SELECT n.i, s.j, n.name || '.' || s.suffix AS pattern, n.category, {START} + (3 * n.i + s.j) * {DAY} AS added
  FROM (VALUES {_NAME_ROWS}) AS n(i, name, category), (VALUES {_SUFFIX_ROWS}) AS s(j, suffix)),
entries AS (
  SELECT pattern, 'add' AS action, added AS effective, category FROM domains
  UNION ALL SELECT pattern, 'remove', added + {8 * DAY}, category FROM domains WHERE (i + j) % 2 = 0
  UNION ALL SELECT pattern, 'add', added + {10 * DAY}, 'repeat' FROM domains WHERE (i + j) % 3 = 0),
captures AS (
  SELECT page_id, {START} + (page_id % 720) * {HOUR} AS fetched_at,
    nullif(lower(regexp_replace(regexp_extract(url, '{HOST}', 1), '\\.$', '')), '') AS host
  FROM pages),
states AS (
  SELECT c.page_id, e.pattern, arg_max(e.action, e.effective) AS action, arg_max(e.category, e.effective) AS category
  FROM captures c JOIN entries e ON (c.host = e.pattern OR ends_with(c.host, '.' || e.pattern)) AND e.effective <= c.fetched_at
  GROUP BY c.page_id, e.pattern),
hits AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
  FROM states WHERE action = 'add' GROUP BY page_id)
SELECT c.page_id, c.host, CAST(c.fetched_at AS BIGINT) AS fetched_at, CAST(coalesce(h.n, 0) AS BIGINT) AS n_entries,
  coalesce(h.categories, '') AS categories, h.n IS NOT NULL AS blocked
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id
"""
