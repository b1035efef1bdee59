"""Keeping the first of a kind for a while: a row is a repeat if a kept row of its key lies within a span before it.

The span counts from the last *kept* row, so which rows stay is a chain: the first, then the first beyond its span, and so
on. Time is cut into buckets a span wide, so a bucket holds one kept row at most. Each moment points to the next one beyond its
span, found inside one bucket; then the chain of every key is followed by doubling: after k rounds the first 2^k kept
rows of every key are known and pointers are 2^k long. Rows of one key and moment are one entry from the first partial
aggregate on, and no window is wider than a bucket, so a key with a third of all rows is dealt out by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.plans.storage import Stored


def _next_of(spots: DataFrame, width: int) -> DataFrame:
    """key, at, to: the least moment of the key that is `width` or more later; none without one. spots: key, bucket, at."""
    heads = spots.groupBy("key", "bucket").agg(F.min("at").alias("head"))
    by_bucket = Window.partitionBy("key").orderBy("bucket")  # a row for each span that has any
    ahead = heads.select("key", "bucket", *(F.lead(F.struct("bucket", "head"), k).over(by_bucket).alias(f"ahead{k}") for k in (1, 2)))
    probes = spots.select("key", (F.col("bucket") + 1).alias("bucket"), (F.col("at") + width).alias("t"), F.lit(1).alias("probe"))
    held = spots.select("key", "bucket", F.col("at").alias("t"), F.lit(0).alias("probe")).unionByName(probes)
    falling = Window.partitionBy("key", "bucket").orderBy(F.desc("t"), "probe").rowsBetween(Window.unboundedPreceding, 0)
    found = held.withColumn("to", F.last(F.when(F.col("probe") == 0, F.col("t")), ignorenulls=True).over(falling)).where("probe = 1")
    found = found.select("key", (F.col("bucket") - 1).alias("bucket"), (F.col("t") - width).alias("at"), "to").join(ahead, ["key", "bucket"])
    beside = F.col("ahead1.bucket") == F.col("bucket") + 1
    to = F.when(beside, F.coalesce("to", "ahead2.head")).otherwise(F.col("ahead1.head"))
    return found.select("key", "at", to.alias("to")).where("to is not null")


def _chains(spots: DataFrame, width: int) -> DataFrame:
    """key, at of the kept moments: each key's first, and from each the next."""
    starts = spots.groupBy("key").agg(F.min("at").alias("at"))
    pointers = Stored(_next_of(spots, width))
    # only what something points to, and the first, can be kept
    ends = starts.union(pointers.rows.select("key", F.col("to").alias("at"))).distinct()
    reached, jumps = Stored(starts), Stored(pointers.rows.join(ends, ["key", "at"], "left_semi"))
    pointers.drop()
    while True:
        hop = Stored(reached.rows.join(jumps.rows, ["key", "at"]).select("key", F.col("to").alias("at")))
        if hop.rows.isEmpty():
            hop.drop()
            jumps.drop()
            return reached.rows
        both = Stored(reached.rows.union(hop.rows))
        longer = Stored(jumps.rows.join(jumps.rows.select("key", F.col("at").alias("to"), F.col("to").alias("beyond")), ["key", "to"]).select("key", "at", F.col("beyond").alias("to")))
        for old in (reached, hop, jumps):
            old.drop()
        reached, jumps = both, longer


def _covers(spots: DataFrame, fixed: DataFrame, width: int) -> DataFrame:
    """key, at, by: the last of the fixed rows (key, bucket, at, id) that is no later than a spot and less than `width` before it; null without one."""
    points = fixed.groupBy("key", "bucket", "at").agg(F.max("id").alias("id"))
    both = points.select("key", "bucket", "at", F.lit(0).alias("asks"), F.struct("at", "id").alias("is")).unionByName(spots.select("key", "bucket", "at", F.lit(1).alias("asks"), F.lit(None).cast("struct<at:bigint,id:string>").alias("is")))
    rising = Window.partitionBy("key", "bucket").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("own", F.last("is", ignorenulls=True).over(rising)).where("asks = 1")
    before = points.groupBy("key", (F.col("bucket") + 1).alias("bucket")).agg(F.max(F.struct("at", "id")).alias("last"))
    seen = own.join(before, ["key", "bucket"], "left").select("key", "bucket", "at", F.coalesce("own", "last").alias("by"))
    return seen.select("key", "bucket", "at", F.when(F.col("by.at") > F.col("at") - width, F.col("by.id")).alias("by"))


def first_for_a_while(rows: DataFrame, span: int, fixed: DataFrame | None = None) -> DataFrame:
    """key, at, id, match over rows (key, at: a whole number, id: text): null for rows that stay, else the kept row that hides it.

    Rows are taken in the order of at and id; a row hides those of its key up to `span` later. fixed: rows (key, at,
    id) that are kept already; of equal times they come first. A row without key or time hides nothing and stays.
    """
    width = span + 1
    placed = rows.select("key", F.col("at").cast("long").alias("at"), F.col("id").cast("string").alias("id")).withColumn("bucket", F.floor(F.col("at") / width).cast("long"))
    sound = placed.where("key is not null and at is not null")
    spots = sound.groupBy("key", "bucket", "at").agg(F.min("id").alias("id"))
    covered = None
    if fixed is not None:
        held = fixed.select("key", F.col("at").cast("long").alias("at"), F.col("id").cast("string").alias("id")).where("key is not null and at is not null")
        covered = Stored(_covers(spots.drop("id"), held.withColumn("bucket", F.floor(F.col("at") / width).cast("long")), width))
        spots = spots.join(covered.rows.where("by is null").select("key", "at"), ["key", "at"], "left_semi")
    open_spots = Stored(spots.select("key", "bucket", "at", "id"))
    kept = open_spots.rows.join(_chains(open_spots.rows.select("key", "bucket", "at"), width), ["key", "at"])
    kept = Stored(kept.select("key", "bucket", F.struct("at", "id").alias("kept")))
    open_spots.drop()
    out = sound.join(kept.rows.select("key", "bucket", F.col("kept").alias("own")), ["key", "bucket"], "left")
    out = out.join(kept.rows.select("key", (F.col("bucket") + 1).alias("bucket"), F.col("kept").alias("last")), ["key", "bucket"], "left")
    order = F.struct("at", "id")
    match = F.when(F.col("own") < order, F.col("own.id")).when(F.coalesce(F.col("own") == order, F.lit(False)), None).when(F.col("last.at") > F.col("at") - width, F.col("last.id"))
    if covered is not None:
        out = out.join(covered.rows.drop("bucket"), ["key", "at"], "left")
        match = F.coalesce("by", match)
    without = placed.where("key is null or at is null").select("key", "at", "id", F.lit(None).cast("string").alias("match"))
    return out.select("key", "at", "id", match.alias("match")).union(without)
