"""What was asked of others, kept between runs: answers, failures, attempts, and when to ask again.

A run joins its keys with the kept table, asks for those that are new or due, each once, and appends a version of each: the
back-off is a time in the table, and nobody waits for it. A key that has its answer is never asked again; one that failed
for good, or as often as is allowed, has no due time. The answers are written before they are read, so a task that
runs again asks again at worst, and what is kept is what one run wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.storage import Stored, delete, exists, rename

FORM = "key string, answer string, exception string, attempts int, due double, log array<string>, at double"
#: Failures that may pass.
PASSING = (ConnectionError, TimeoutError)


class Answers:
    """A table of answers under a path; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, attempts: int = 3, base: float = 60.0, lanes: int = 2):
        """attempts: of a key in all. base: seconds before the second attempt, twice as many before each further one. lanes: tasks that ask one host at once."""
        self.spark, self.path, self.attempts, self.base, self.lanes = spark, path, attempts, base, lanes
        if not exists(spark, path):
            spark.createDataFrame([], FORM).write.parquet(path)

    @property
    def latest(self) -> DataFrame:
        """The last version of each key."""
        rows = self.spark.read.schema(FORM).parquet(self.path)
        return rows.groupBy("key").agg(F.max_by(F.struct(*rows.columns), F.struct("attempts", "at")).alias("x")).select("x.*")

    def due(self, keys: DataFrame, now: float) -> DataFrame:
        """key, attempts, log of the keys to ask for now: unknown ones, and failed ones whose time has come."""
        known = self.latest.join(keys.select("key").distinct(), "key", "left_semi").select("key", "answer", "attempts", "due", "log")
        asked = keys.select("key").where(F.col("key").isNotNull()).distinct().join(known, "key", "left")
        fresh = F.col("attempts").isNull() | (F.col("answer").isNull() & (F.col("due") <= now))
        return asked.where(fresh).select("key", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("log", F.array().cast("array<string>")).alias("log"))

    def run(self, keys: DataFrame, ask: Callable[[str], str], now: float, passing: tuple[type[Exception], ...] = PASSING) -> DataFrame:
        """The latest version of each of keys (a column key) after a run at `now` seconds. ask: from a key to its answer; an empty one is a failure that may pass."""
        attempts, base = self.attempts, self.base

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for key, tried, log in zip(batch["key"], batch["attempts"], batch["log"], strict=True):
                    answer, exception, again = None, None, True
                    try:
                        answer = ask(key) or None
                        exception = None if answer else "EmptyAnswer: nothing came back"
                    except Exception as e:  # noqa: BLE001  a failure is a row
                        exception, again = f"{type(e).__name__}: {e}"[:200], isinstance(e, passing)
                    n = int(tried) + 1
                    due = now + base * 2 ** (n - 1) if exception and again and n < attempts else None
                    line = f"attempt {n}: {exception or 'ok'}" + (f"; again in {base * 2 ** (n - 1):g} s" if due else "")
                    out.append((key, answer, exception, n, due, [*log, line], now))
                yield pd.DataFrame(out, columns=["key", "answer", "exception", "attempts", "due", "log", "at"]).astype({"due": "float64"})

        host = F.lower(F.coalesce(F.try_parse_url(F.col("key"), F.lit("HOST")), F.lit("")))
        lane = F.pmod(F.xxhash64("key"), F.lit(self.lanes))
        # a host's keys go to as many tasks as it has lanes
        taken = self.due(keys, now).repartition(host, lane)
        said = Stored(taken.mapInPandas(call, FORM).withColumn("due", F.nanvl("due", F.lit(None).cast("double"))))
        said.rows.write.mode("append").parquet(self.path)
        said.drop()
        return self.latest.join(keys.select("key").distinct(), "key", "left_semi")

    def compact(self) -> None:
        """Only the last version of each key; nobody reads or writes meanwhile."""
        fresh, old = f"{self.path}.next", f"{self.path}.old"
        self.latest.write.mode("overwrite").parquet(fresh)
        rename(self.spark, self.path, old)
        rename(self.spark, fresh, self.path)
        delete(self.spark, old)


def resolved(links: DataFrame, kept: Answers, resolve: Callable[[str], str], now: float, link: str = "link", wrapper: str = "news.google") -> DataFrame:
    """links with resolved_link, resolve_status (ok, skipped, failed; waiting if it is to be tried again), resolve_error and resolve_attempts. Only wrapper links are asked for; one that stays a wrapper has failed for now."""

    def unwrapped(url: str) -> str:
        out = resolve(url)
        if wrapper in (out or ""):
            raise ConnectionError("still a wrapper")
        return out

    wrapped = F.coalesce(F.col(link).contains(wrapper), F.lit(False))
    answers = kept.run(links.where(wrapped).select(F.col(link).alias("key")), unwrapped, now)
    own = answers.select(F.col("key").alias("_key"), F.col("answer").alias("_answer"), F.col("exception").alias("_exception"), F.col("attempts").alias("_attempts"), F.col("due").alias("_due"))
    out = links.join(own, F.col(link) == F.col("_key"), "left")
    status = F.when(~wrapped, "skipped").when(F.col("_answer").isNotNull(), "ok").when(F.col("_due").isNotNull(), "waiting").otherwise("failed")
    return out.select(*links.columns, F.when(wrapped, F.col("_answer")).otherwise(F.col(link)).alias("resolved_link"), status.alias("resolve_status"), F.col("_exception").alias("resolve_error"), F.coalesce("_attempts", F.lit(0)).alias("resolve_attempts"))
