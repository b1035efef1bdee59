"""The layered cascade: a row is a duplicate if a layer matches it with an earlier row that is new.

Rows are decided together by rounds, not one by one: a row is a duplicate as soon as an earlier match is
known to be new, and new as soon as every earlier match is known to be a duplicate. The least undecided row can
always be decided, so the rounds end; only undecided and new rows are held. A batch meets decided rows first (`resolve_batch`),
whose decisions are fixed, and then itself. Equal hashes and equal titles are handled by class (the least new and
the least undecided row of each), so a group of copies is never paired within itself. Rows meet in shuffles whatever their number
(hint "merge"): a broadcast goes through the driver, and those of all rounds and batches would add up there to more than the table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import id_hash, nz, stored_title_hash, tokens
from tidewire.operators.keyed import KeyedStore
from tidewire.operators.similarity import similar_between, similar_classes, title_classes, top_cosine
from tidewire.operators.store import numbered
from tidewire.plans.storage import Stored, exists

#: Hours back that title hashes, title words and vectors are matched.
HOURS = (72, 24, 72)


def items_of(files: DataFrame, now: float, after: int = 0) -> DataFrame:
    """Raw Markdown files (slug, title, url, excerpt) as rows of the cascade, numbered in name order; without a title the slug stands for it, and without a URL a local one. A file without anything to read is a row like any other."""
    title = F.coalesce(nz(F.col("title")), F.col("slug"))
    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")
    rows = files.select("slug", "url", path.alias("content_path"), title.alias("title"), F.coalesce("excerpt", F.lit("")).alias("excerpt"), id_hash(F.col("url"), F.col("slug")).alias("id_hash"), stored_title_hash(title).alias("title_hash"), F.lit(now).alias("created_at"))
    return numbered(rows, ["slug"], after)


def _least(frame: DataFrame, key: str, name: str, flag: str | None = None) -> DataFrame:
    """Of each key, the least new and the least undecided row that may match by this layer."""
    near_by = F.col(flag) if flag else F.lit(True)
    return frame.groupBy(key).agg(F.min(F.when(near_by & (F.col("status") == "new"), F.col("rowid"))).alias(f"new_{name}"), F.min(F.when(near_by & F.col("status").isNull(), F.col("rowid"))).alias(f"open_{name}"))


def _seen(rows: DataFrame, live: DataFrame, links: DataFrame, near: DataFrame | None) -> DataFrame:
    """rows with the least new and undecided rows that each layer links them with."""
    seen = rows.join(_least(live, "id_hash", "id").hint("merge"), "id_hash", "left").join(_least(live, "title_hash", "title", "in_title").hint("merge"), "title_hash", "left")
    words = links.join(_least(live, "own", "words", "in_words").withColumnRenamed("own", "other").hint("merge"), "other").groupBy("own").agg(F.min("new_words").alias("new_words"), F.min("open_words").alias("open_words"))
    seen = seen.join(words.hint("merge"), "own", "left")
    if near is None:
        return seen.withColumns({"new_near": F.lit(None).cast("long"), "open_near": F.lit(None).cast("long"), "near_layer": F.lit(None).cast("int")})
    known = near.join(live.select(F.col("rowid").alias("b"), "status").hint("merge"), "b").groupBy(F.col("a").alias("rowid"))
    known = known.agg(F.min(F.when(F.col("status") == "new", F.col("b"))).alias("new_near"), F.min(F.when(F.col("status").isNull(), F.col("b"))).alias("open_near"), F.min(F.when(F.col("status") == "new", F.col("layer"))).alias("near_layer"))
    return seen.join(known.hint("merge"), "rowid", "left")


LAYERS = ("id", "title", "words", "near")


def resolve(items: DataFrame, neighbours: DataFrame | None = None, over: float = 0.4, high: float = 0.85, low: float = 0.75, judge: Callable[[DataFrame], DataFrame] | None = None, now: float | None = None, hours: tuple[float, float, float] = HOURS, fixed: DataFrame | None = None) -> DataFrame:
    """rowid, status, layer over items (rowid, id_hash, title_hash, title).

    neighbours: (a, b, score) with b < a, the vector layer's candidates. Scores over `high` match; those in (low, high]
    go to `judge`, which returns those (a, b) that are the same (none without a judge). layer: the first that matches, by
    hash 0, title hash 1, title words 2, vectors 3, judge 4. now: seconds; if given, a row (created_at) is a match by title
    hash, title words and vectors only for the hours back from it. fixed: (rowid, layer), the first layer by which a row
    matches one that was decided before.
    """
    classes = Stored(title_classes(items))
    pairs = similar_classes(classes.rows, over)
    links = Stored(pairs.select("a", "b").union(pairs.select("b", "a")).union(classes.rows.select("class_id", "class_id")).toDF("own", "other"))
    back = [F.lit(True) if now is None else F.coalesce(F.col("created_at") >= now - 3600 * h, F.lit(False)) for h in hours]
    rows = items.select("rowid", "id_hash", "title_hash", *(c.alias(f"in_{n}") for n, c in zip(LAYERS[1:], back, strict=True)), F.array_sort(tokens(F.col("title"))).alias("tokens"))
    rows = rows.join(classes.rows.selectExpr("tokens", "class_id own").hint("merge"), "tokens").drop("tokens")
    before = items.sparkSession.createDataFrame([], "rowid long, fixed int") if fixed is None else fixed.groupBy("rowid").agg(F.min("layer").cast("int").alias("fixed"))
    rows = Stored(rows.join(before.hint("merge"), "rowid", "left"))
    classes.drop()
    near = None
    if neighbours is not None:
        sure = neighbours.where(F.col("score") > high).select("a", "b", F.lit(3).alias("layer"))
        if judge is not None:
            sure = sure.unionByName(judge(neighbours.where((F.col("score") > low) & (F.col("score") <= high))).select("a", "b", F.lit(4).alias("layer")))
        near = Stored(sure.join(rows.rows.where("in_near").select(F.col("rowid").alias("b")).hint("merge"), "b", "left_semi"))
    edges = near.rows if near else None

    def earlier(kind: str):
        hit = F.lit(False)
        for name in LAYERS:
            hit = hit | F.coalesce(F.col(f"{kind}_{name}") < F.col("rowid"), F.lit(False))
        return hit

    # what may still match: new rows, and undecided ones; duplicates leave
    live = Stored(rows.rows.where("fixed is null").withColumn("status", F.lit(None).cast("string")))
    while not live.rows.where("status is null").isEmpty():
        seen = _seen(live.rows.where("status is null").drop("status"), live.rows, links.rows, edges)
        decided = seen.where(~earlier("new")).withColumn("status", F.when(~earlier("open"), "new"))
        after = Stored(live.rows.where("status = 'new'").unionByName(decided.select(*live.rows.columns)))
        live.drop()
        live = after
    told = _seen(rows.rows, live.rows, links.rows, edges)
    layer = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(LAYERS))):
        layer = F.when(F.coalesce(F.col(f"new_{name}") < F.col("rowid"), F.lit(False)), F.col("near_layer") if name == "near" else F.lit(k)).otherwise(layer)
    told = told.withColumn("layer", F.least("fixed", layer))
    out = Stored(told.select("rowid", F.when(F.col("layer").isNull(), "new").otherwise("dupe").alias("status"), "layer"))
    for old in (rows, links, live, *([near] if near else [])):
        old.drop()
    return out.rows


def resolve_batch(batch: DataFrame, recent: DataFrame, known: DataFrame, now: float, over: float = 0.4, high: float = 0.85, low: float = 0.75, judge: Callable[[DataFrame], DataFrame] | None = None, hours: tuple[float, float, float] = HOURS, k: int = 10) -> DataFrame:
    """rowid, status, layer of a batch against decided rows, which stay as they are.

    batch: rowid, id_hash, title_hash, title, embedding (null without a vector), with larger rowids than any decided row. recent: the decided rows of
    the longest window (the same columns, created_at, status). known: id_hash and rowid of new rows of any age that
    share an id_hash with the batch. Words and vectors meet only what lies in their own window: a band of time, not the
    whole store. Of the vectors each row's k nearest earlier ones in the band count, whatever their status.
    """
    title_band, words_band, near_band = (recent.where(F.col("created_at") >= now - 3600 * h) for h in hours)
    is_new = F.col("status") == "new"
    own = batch.select("rowid", "id_hash", "title_hash", F.array_sort(tokens(F.col("title"))).alias("tokens"))
    hits = [own.join(known.select("id_hash", F.col("rowid").alias("by")).hint("merge"), "id_hash").where("by < rowid").select("rowid", F.lit(0).alias("layer"))]
    hits.append(own.join(title_band.where(is_new).select("title_hash").distinct().hint("merge"), "title_hash", "left_semi").select("rowid", F.lit(1).alias("layer")))
    classes, stored = title_classes(batch), title_classes(words_band.where(is_new))
    alike = similar_between(classes, stored, over).select(F.col("a").alias("class_id")).distinct()
    hits.append(own.join(classes.join(alike.hint("merge"), "class_id", "left_semi").select("tokens").hint("merge"), "tokens", "left_semi").select("rowid", F.lit(2).alias("layer")))
    asked = batch.select(F.col("rowid").alias("vec_id"), "embedding")
    there = near_band.select(F.col("rowid").alias("vec_id"), "embedding").unionByName(asked)
    near = Stored(top_cosine(asked, there, k, earlier=True, over=high if judge is None else low).select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), "score"))
    old = near.rows.join(near_band.where(is_new).select(F.col("rowid").alias("b")).hint("merge"), "b", "left_semi")
    hits.append(old.where(F.col("score") > high).select(F.col("a").alias("rowid"), F.lit(3).alias("layer")))
    if judge is not None:
        unsure = old.where((F.col("score") > low) & (F.col("score") <= high)).select("a", "b", "score")
        hits.append(judge(unsure).select(F.col("a").alias("rowid"), F.lit(4).alias("layer")))
    inside = near.rows.join(batch.select(F.col("rowid").alias("b")).hint("merge"), "b", "left_semi").select("a", "b", "score")
    out = resolve(batch, inside, over, high, low, judge, fixed=reduce(DataFrame.unionByName, hits))
    near.drop()
    return out


class Decisions:
    """Decided items under a path, by day of their time, and the id_hash of each new one in a store by key.

    A batch reads the days of its windows and the buckets that may hold its id_hashes. Its id_hashes are written first: a batch that failed
    between the two gets the same rowids again, so it does not take its own for earlier ones. One writer at a time.
    """

    FORM = "rowid long, id_hash string, title_hash string, title string, excerpt string, content_path string, embedding array<double>, created_at double, status string, layer int"

    def __init__(self, spark: SparkSession, path: str, hours: tuple[float, float, float] = HOURS, buckets: int = 64):
        self.spark, self.items_path, self.hours = spark, f"{path}/items", hours
        if not exists(spark, self.items_path):
            spark.createDataFrame([], f"{self.FORM}, day date").write.parquet(self.items_path)
        self.ids = KeyedStore(spark, f"{path}/ids", spark.createDataFrame([], "id_hash string, rowid long").schema, "id_hash", buckets)

    @property
    def items(self) -> DataFrame:
        return self.spark.read.schema(f"{self.FORM}, day date").parquet(self.items_path)

    def recent(self, now: float) -> DataFrame:
        """The items of the longest window, out of its days alone."""
        since = now - 3600 * max(self.hours)
        return self.items.where((F.col("day") >= F.to_date(F.timestamp_seconds(F.lit(since)))) & (F.col("created_at") >= since))

    def last_rowid(self) -> int:
        """Of the last day that has items: rowids rise with time."""
        day = self.items.agg(F.max("day")).first()[0]
        return self.items.where(F.col("day") == day).agg(F.max("rowid")).first()[0] if day else 0

    def feed(self, batch: DataFrame, now: float, judge: Callable[[DataFrame], DataFrame] | None = None, **levels) -> DataFrame:
        """Decides a batch (rowid, id_hash, title_hash, title, and what else the form has), keeps it, and returns its items. Each row has its own content_path, by rowid: a duplicate never touches the row it repeats."""
        form = self.spark.createDataFrame([], self.FORM).schema
        own = [F.col(f.name).cast(f.dataType) if f.name in batch.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in form if f.name not in ("created_at", "status", "layer")]
        rows = Stored(batch.select(*own))
        known = Stored(self.ids.held(rows.rows, ["rowid"]))
        decided = resolve_batch(rows.rows, self.recent(now), known.rows, now, judge=judge, hours=self.hours, **levels)
        out = Stored(rows.rows.join(decided.hint("merge"), "rowid").withColumns({"created_at": F.lit(float(now)), "day": F.to_date(F.timestamp_seconds(F.lit(now)))}))
        self.ids.add(out.rows.where("status = 'new'").select("id_hash", "rowid"), ["rowid"])
        out.rows.select(*(f.name for f in form), "day").repartition("day").write.mode("append").partitionBy("day").parquet(self.items_path)
        for old in (rows, known):
            old.drop()
        return out.rows.select(*(f.name for f in form))
