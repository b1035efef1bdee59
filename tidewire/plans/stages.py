"""Whole stage runs over a store of articles: collect, classify, fetch, dedup, retry, summarize.

The store is two tables. The queue (pending and failed rows of the queue's categories that are no duplicates) is written
whole by every run; a row that leaves it is appended once to the closed rows, by run and day of collection, and never
changes again. So a run costs what its queue and its batch cost, not what the store holds, and all articles are the
two tables together, without a shuffle. What is known by link or by hash is asked of two stores by key.

A run writes its tables beside the old ones, then one small file that names them; until that is there the run has not
happened, and one that failed leaves folders that nobody reads and the next one replaces. The keys of new rows are added
once the rows count; a run that finds the last one's missing adds them first. One writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewire.functions import payloads, rules, text
from tidewire.functions.dates import after_cutoff
from tidewire.operators import dedup, feed, store
from tidewire.operators.keyed import BUCKETS, WORDS, KeyedStore
from tidewire.operators.runs import collect_totals, stage_lines, store_state, summary_totals
from tidewire.plans.storage import Stored, _located, delete, exists, rename
from tidewire.sources import readers, writers

#: Rows of the Arrow batches that bring texts to Python, so that a worker's memory does not grow with a task's rows.
TEXT_ROWS = 500
ARTICLE = (
    "article_hash string, title_hash string, title string, link string, raw_link string, published_at string, collected_at string, "
    "category string, tag string, product_line string, source_id string, source_name string, feed_type string, content_kind string, "
    "action_description string, image_url string, summary string, competitor_analysis string, event_type string, alert_level string, "
    "is_launch boolean, summary_status string, dedup_decision string, dedup_layer int, dedup_reason string, dedup_match_hash string, "
    "ai_model string, ai_processed_at string, extra string, batch long"
)
NAMES = [x.split()[0] for x in ARTICLE.split(", ")]
REPORT = "stage string, started_at double, ended_at double, success boolean, details map<string,string>"
#: The stages of a run that names none.
USUAL = ("collect", "fetch", "dedup", "summarize")


@dataclass(frozen=True)
class State:
    """What counts: the last run, the run that wrote the queue, the one that wrote it before (whose readers may not have ended), those that closed rows, and one whose keys are still to be added."""

    run: int = 0
    queue: int = 0
    before: int = 0
    closed: tuple[int, ...] = ()
    unkeyed: int = 0


def _queued() -> Column:
    return F.coalesce(F.col("summary_status").isin("pending", "failed") & F.col("category").isin(*store.QUEUE_CATEGORIES) & ~F.col("dedup_decision").eqNullSafe("duplicate"), F.lit(False))


class ArticleRuns:
    """The store under a path and its stages; `now` is an ISO time in UTC that the caller's clock gives."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, words: int = WORDS):
        self.spark, self.path = spark, path
        self.schema = StructType.fromDDL(ARTICLE)
        self.links, self.hashes = (KeyedStore(spark, f"{path}/{name}", StructType([StructField(key, StringType())]), key, buckets, words) for name, key in (("links", "link_hash"), ("hashes", "article_hash")))

    # What is there ------------------------------------------------------------------------------------

    @property
    def state(self) -> State:
        files, folder = _located(self.spark, f"{self.path}/state")
        if not files.exists(folder):
            return State()
        last = max((f.getPath().getName() for f in files.listStatus(folder) if f.getPath().getName().endswith(".json")), default=None)
        if last is None:
            return State()
        stream = files.open(_located(self.spark, f"{self.path}/state/{last}")[1])
        said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return State(**said | {"closed": tuple(said["closed"])})

    def _put(self, state: State) -> None:
        """The file's name tells its order: a run, and whether its keys are added."""
        name = f"{self.path}/state/{state.run:010d}-{int(not state.unkeyed)}.json"
        if exists(self.spark, name):
            raise RuntimeError(f"another writer has finished run {state.run}")
        files, draft = _located(self.spark, f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(json.dumps(asdict(state)).encode())
        out.close()
        files.mkdirs(_located(self.spark, f"{self.path}/state")[1])
        rename(self.spark, draft.toString(), name)

    @property
    def queue(self) -> DataFrame:
        n = self.state.queue
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/queue/run={n}") if n else self.spark.createDataFrame([], self.schema)

    def closed(self, since: str | None = None) -> DataFrame:
        """Rows that have left the queue; of days from `since` on if given, and no others are read."""
        return self._closed_in(self.state.closed, since)

    def _closed_in(self, runs: tuple[int, ...], since: str | None = None) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        held = StructType([*self.schema.fields]).add("day", "string")
        rows = self.spark.read.schema(held).option("basePath", f"{self.path}/closed").parquet(*(f"{self.path}/closed/run={n}" for n in runs))
        return (rows if since is None else rows.where(F.col("day") >= since)).select(*NAMES)

    @property
    def articles(self) -> DataFrame:
        return self.queue.unionByName(self.closed())

    def status(self, sources: DataFrame) -> DataFrame:
        return store_state(self.articles, sources)

    # Writing ------------------------------------------------------------------------------------------

    def _finish(self, after: DataFrame, unkeyed: bool = False) -> None:
        """The queue's rows as they are after a run, new ones among them: those that leave it are closed."""
        old = self.state
        n, left = old.run + 1, Observation()
        rows = Stored(after.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).observe(left, F.count_if(~_queued()).alias("left")))
        rows.rows.where(_queued()).write.mode("overwrite").parquet(f"{self.path}/queue/run={n}")
        closes = left.get["left"] > 0
        if closes:
            day = F.substring("collected_at", 1, 10)
            rows.rows.where(~_queued()).withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/closed/run={n}")
        self._put(State(n, n, old.queue, (*old.closed, n) if closes else old.closed, n if unkeyed else 0))
        rows.drop()
        if old.before:
            delete(self.spark, f"{self.path}/queue/run={old.before}")

    def _settle(self) -> None:
        """Adds the keys of the last run's new rows if it ended before it did so."""
        held = self.state
        if held.unkeyed:
            rows = self.queue.unionByName(self._closed_in(tuple(n for n in held.closed if n == held.unkeyed)))
            fresh = Stored(rows.where(F.col("batch") == held.unkeyed).select("article_hash", F.md5("raw_link").alias("link_hash")))
            self.links.add(fresh.rows.select("link_hash"), ["link_hash"])
            self.hashes.add(fresh.rows.select("article_hash"), ["article_hash"])
            fresh.drop()
            self._put(replace(held, unkeyed=0))

    def _changed(self, changes: DataFrame) -> None:
        """Columns of changes (with article_hash, at most one row each) over the queue's rows."""
        fresh = [c for c in changes.columns if c != "article_hash"]
        own = changes.select("article_hash", F.struct(*fresh).alias("_new"))
        rows = self.queue.join(own, "article_hash", "left")
        self._finish(rows.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in NAMES)))

    def compact(self) -> None:
        """The closed rows of all runs as one, by day; nobody reads or writes meanwhile."""
        self._settle()
        held = self.state
        if len(held.closed) > 1:
            n = held.run + 1
            rows = self.closed().withColumn("day", F.substring("collected_at", 1, 10))
            rows.repartition("day", F.pmod(F.xxhash64("article_hash"), F.lit(8))).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/closed/run={n}")
            self._put(replace(held, run=n, closed=(n,)))
            for old in held.closed:
                delete(self.spark, f"{self.path}/closed/run={old}")

    # Stages -------------------------------------------------------------------------------------------

    def collect(self, items: DataFrame, sources: DataFrame, now: str, cutoff: Column | None = None, cap: int | None = None, resolve: Callable[[DataFrame], DataFrame] | None = None) -> Stored:
        """Takes items (source_id, pos, title, link, published_at, summary_text, image_url) of known sources into the queue.

        A source's first `cap` items in feed order are looked at; the first reason of dedup.REASONS that holds drops one. Of items with one
        hash in a batch the first by source and place is new, the others count as hash_dedup. The items are read twice: to be sifted, and for the texts of those that are new,
        which source, place and link name. resolve: adds resolved_link and
        resolve_status to candidates; those neither ok nor skipped are unresolved. An item without a link is unresolved, one without a
        date has the day of `now`. Gives the counts by source: found, dropped for each reason, new, duplicate.
        """
        self._settle()
        n = self.state.run + 1
        own = Stored(sources.select("source_id", F.col("name").alias("source_name"), "category", "tag", "product_line", "feed_type", "content_kind"))
        rows = items.select("source_id", F.coalesce("pos", F.lit(-1)).alias("pos"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "published_at", "summary_text", "image_url")), text.nz(F.col("link")).alias("raw_link"))
        kept = rows if cap is None else feed.first_per_feed(rows, cap, "source_id").drop("rank")
        in_time = F.lit(True) if cutoff is None else after_cutoff(F.col("published_at"), cutoff)
        early = F.when(F.col("raw_link").isNull(), "unresolved").when(~in_time, "cutoff")
        beyond = rules.out_of_scope_by_batches(F.when(early.isNull(), F.concat_ws(" ", "title", "summary_text")))
        # the texts stay behind: only what is new meets its text again
        looked = Stored(kept.join(own.rows.select("source_id"), "source_id").select("source_id", "pos", "raw_link", F.md5("raw_link").alias("link_hash"), F.coalesce(early, F.when(beyond, "scope")).alias("drop_reason")), TEXT_ROWS)
        known = self.links.held(looked.rows.where("drop_reason is null").select("link_hash").distinct()).withColumn("_known", F.lit(True))
        sifted = looked.rows.join(known, "link_hash", "left").withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("_known"), "raw_dedup"))).drop("_known")
        open_, shut = sifted.where("drop_reason is null").drop("drop_reason"), sifted.where("drop_reason is not null")
        found = open_.withColumns({"resolved_link": F.col("raw_link"), "resolve_status": F.lit("skipped")}) if resolve is None else resolve(open_)
        ok = F.coalesce(F.col("resolve_status").isin("ok", "skipped"), F.lit(False))
        asked = Stored(found.withColumns({"article_hash": F.when(ok, F.md5("resolved_link")), "_row": F.monotonically_increasing_id()}))
        first = asked.rows.where("article_hash is not null").groupBy("article_hash").agg(F.min_by("_row", F.struct("source_id", "pos", "raw_link", "_row")).alias("_first"))
        held = self.hashes.held(asked.rows.select("article_hash").distinct()).withColumn("_held", F.lit(True))
        judged = asked.rows.join(first, "article_hash", "left").join(held, "article_hash", "left")
        again = F.coalesce("_held", F.col("_first") != F.col("_row"))
        reason = F.when(F.col("article_hash").isNull(), "unresolved").when(again, "hash_dedup")
        decided = Stored(judged.withColumn("drop_reason", reason).drop("_first", "_held", "_row"))
        every = decided.rows.select("source_id", "drop_reason").unionByName(shut.select("source_id", "drop_reason"))
        counts = items.join(own.rows.select("source_id"), "source_id").groupBy("source_id").agg(F.count("*").alias("found"))
        funnel = Stored(counts.join(dedup.run_funnel(every, "source_id").drop("found"), "source_id", "left").na.fill(0))
        fresh = Stored(decided.rows.where("drop_reason is null").drop("drop_reason").join(own.rows, "source_id"))
        full = fresh.rows.join(rows, ["source_id", "pos", "raw_link"]).dropDuplicates(["article_hash"])
        self._finish(self.queue.unionByName(_articles(full, now, n)), unkeyed=True)
        self._settle()
        for old in (own, looked, asked, decided, fresh):
            old.drop()
        return funnel

    def classify(self) -> dict[str, object]:
        """Event, alert and launch of the pending rows by the rules."""
        pending = store.queue(self.queue, "pending").select("article_hash", rules.classify_article(F.col("title"), F.col("action_description")).alias("v"))
        changes = Stored(pending.select("article_hash", "v.event_type", "v.alert_level", "v.is_launch"))
        self._changed(changes.rows)
        return {"updated": _count(changes)}

    def fetch(self, fetch: Callable[[str], str], folder: str, run: str) -> dict[str, object]:
        """Pages of the pending rows as Markdown under a folder, by run and source; social posts are archived as they are, without a request. fetch: from a link to a page. A row without an image takes the page's."""
        pending = Stored(store.queue(self.queue, "pending"))
        social = F.col("feed_type") == "linkedin_company"
        pages = Stored(readers.fetched(pending.rows.where(~social & text.nz(F.col("link")).isNotNull()), fetch, "link").withColumnRenamed("url", "link"))
        rows = pending.rows.join(pages.rows, "link", "left")
        body = F.when(social, F.coalesce(text.nz(F.col("action_description")), F.col("title"))).otherwise(text.nz(text.strip(text.visible_text(F.col("body")))))
        image = F.coalesce(text.nz(F.col("image_url")), F.when(~social, text.nz(text.og_image(F.col("body")))), F.lit(""))
        done = Stored(rows.withColumns({"markdown": body, "image_url": image}).drop("body", "error"))
        writers.write_documents(writers.markdown(done.rows.where("markdown is not null")), folder, run)
        self._changed(done.rows.select("article_hash", "image_url"))
        total, fetched = done.rows.agg(F.count("*"), F.count("markdown")).first()
        for old in (pending, pages, done):
            old.drop()
        return {"total": total, "fetched": fetched, "failed": total - fetched}

    def dedup(self, hours: float = 72) -> dict[str, object]:
        """Titles of the pending rows against the queue and closed rows of the days that `hours` before the first pending row can reach."""
        names = ("article_hash", "title", "collected_at", "summary_status", "category", "dedup_decision")
        first = self.queue.where("summary_status = 'pending'").agg(F.date_format(F.to_timestamp(F.min("collected_at")) - F.make_dt_interval(hours=F.lit(int(hours) + 24)), "yyyy-MM-dd")).first()[0]
        rows = self.queue.select(*names).unionByName(self.closed(first).select(*names)) if first else self.queue.select(*names)
        found = Stored(dedup.run_pending(rows, hours).drop("dedup_score"))
        self._changed(found.rows)
        total, hits = found.rows.agg(F.count("*"), F.count("dedup_match_hash")).first()
        found.drop()
        return {"total": total, "new": total - hits, "duplicates": hits}

    def retry(self) -> dict[str, object]:
        """Failed rows are pending again."""
        back = Stored(self.queue.where("summary_status = 'failed'").select("article_hash", F.lit("pending").alias("summary_status")))
        self._changed(back.rows)
        return {"reset": _count(back)}

    def summarize(self, ask: Callable[[str], str], now: str, model: str = "", limit: int = 20_000, folder: str | None = None, run: str = "") -> dict[str, object]:
        """Asks a model once for each pending row: summarized, irrelevant, or failed with its error in `extra`. Summaries go as JSON under a folder if one is given."""
        said_before = text.nz(F.col("summary"))
        content = F.concat(F.coalesce(F.concat(said_before, F.lit("\n\n")), F.lit("")), F.coalesce("action_description", F.lit("")))
        asked = store.queue(self.queue, "pending").select("article_hash", readers.summary_prompt(F.col("title"), content, limit).alias("content"))
        said = Stored(readers.summarized(asked, ask), TEXT_ROWS)
        read = said.rows.select("article_hash", "error", F.when(F.col("error").isNull(), payloads.normalized_summary(F.col("raw"))).alias("s"))
        read = read.select("article_hash", F.coalesce("error", "s.error").alias("error"), F.col("s.relevant").alias("relevant"), "s")
        done = Stored(read.join(self.queue, "article_hash"))
        fine = F.col("error").isNull() & F.col("relevant")
        status = F.when(F.col("error").isNotNull(), "failed").when(~F.col("relevant"), "irrelevant").otherwise("ai_generated")
        given = {c: F.when(fine, F.col(f"s.{c}")).otherwise(F.col(c)) for c in ("summary", "competitor_analysis", "event_type", "alert_level")}
        given |= {"title": F.when(fine, F.coalesce(text.nz(F.col("s.title")), F.col("title"))).otherwise(F.col("title")), "ai_model": F.when(fine, F.lit(model)).otherwise(F.col("ai_model"))}
        given |= {"ai_processed_at": F.when(fine, F.lit(now)).otherwise(F.col("ai_processed_at")), "extra": F.coalesce("error", "extra"), "summary_status": status}
        if folder is not None:
            written = done.rows.where(fine).select(*((given[c] if c in given else F.col(c)).alias(c) for c in NAMES))
            writers.write_documents(writers.summary_json(written), folder, run)
        self._changed(done.rows.select("article_hash", *(c.alias(name) for name, c in given.items())))
        counts = summary_totals(done.rows).first().asDict()
        said.drop()
        done.drop()
        return {"total": sum(counts.values()), **counts}

    # Reports ------------------------------------------------------------------------------------------

    def staged(self, stage: str, work: Callable[[], dict[str, object]], clock: Callable[[], float] = time.time) -> dict[str, object]:
        """Runs a stage and appends what came of it to the report; a stage that fails is reported and raises. `success` among the details tells whether all went well."""
        began, details, success = clock(), {}, False
        try:
            details = dict(work())
            success = bool(details.pop("success", True))
        except Exception as e:
            details = {"error": f"{type(e).__name__}: {e}"[:500]}
            raise
        finally:
            line = (stage, began, clock(), success, {k: str(v) for k, v in details.items()})
            self.spark.createDataFrame([line], REPORT).write.mode("append").parquet(f"{self.path}/report")
        return details

    def report(self, since: float = 0) -> DataFrame:
        """The lines of stages that began at or after a time, in their order."""
        rows = self.spark.read.schema(REPORT).parquet(f"{self.path}/report").where(F.col("started_at") >= since)
        return stage_lines(rows).orderBy("started_at").select("stage", "text")


def _count(changes: Stored) -> int:
    n = changes.rows.count()
    changes.drop()
    return n


def _articles(fresh: DataFrame, now: str, batch: int) -> DataFrame:
    """New rows of the store from items that stay, with their source's columns."""
    title = text.title_or_source(F.col("title"), F.col("source_name"), F.col("content_kind"))
    made = {
        "title": title, "link": F.col("resolved_link"), "title_hash": text.stored_title_hash(title), "published_at": F.coalesce(text.nz(F.col("published_at")), F.lit(now[:10])), "collected_at": F.lit(now),
        "action_description": F.substring("summary_text", 1, 300), "summary": F.lit(""), "competitor_analysis": F.lit(""), "summary_status": F.lit("pending"), "dedup_decision": F.lit(""), "extra": F.lit(""), "batch": F.lit(batch).cast("long"),
    }
    v = rules.classify_article(title, F.col("summary_text"))
    rows = fresh.withColumn("_v", v)
    made |= {c: F.col(f"_v.{c}") for c in ("event_type", "alert_level", "is_launch")}
    kinds = dict(x.split() for x in ARTICLE.split(", "))
    return rows.select(*((made[c] if c in made else F.col(c) if c in fresh.columns else F.lit(None).cast(kinds[c])).alias(c) for c in NAMES))


def collected(funnel: DataFrame, sources: DataFrame, errors: DataFrame | None = None) -> dict[str, object]:
    """What the collect stage reports of its counts by source: a source with an error (source_id, error) counts as one, any other as ok, also without items."""
    rows = sources.select("source_id").join(funnel, "source_id", "left")
    rows = rows.join(errors.select("source_id", "error"), "source_id", "left") if errors is not None else rows.withColumn("error", F.lit(None).cast("string"))
    rows = rows.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))
    t = collect_totals(rows).first()
    return {"success": t.sources_error == 0, "sources_ok": t.sources_ok, "sources_error": t.sources_error, "items_found": t.found, "items_new": t.new, "items_duplicate": t.duplicate}
