"""A table of rows by key that a batch is joined with without reading all of it.

Rows lie in buckets by a hash of the key. Beside them lies a Bloom filter of each bucket as a table of 64-bit words: a
key sets four bits of one word, so a batch probes it by one equi-join, and what a batch adds is merged by bit_or.
Keys whose bits are not all set are new; only the buckets of the others are read, and only their keys. A batch's bits are
written before its rows: a batch that fails between the two leaves bits too many, which cost a look and no row.

One writer at a time. Rows without a key are not kept. Of a batch's rows with one key the first in `order` is taken, by
partial aggregates, so a hot key is no large group; a batch that comes again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tidewire.plans.storage import Stored, delete, exists, rename

BUCKETS, WORDS = 256, 1 << 14


def _placed(key: Column, buckets: int, words: int) -> tuple[Column, Column, Column]:
    """bucket, word and mask of a key."""
    h, more = F.xxhash64(key), F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for k in range(4):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(more, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(h, F.lit(buckets)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(words)).cast("int"), mask


class KeyedStore:
    """Rows of a schema under a path, at most one for each key. words: of a bucket's filter; four keys a word pass one new key in a hundred."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = BUCKETS, words: int = WORDS):
        self.spark, self.path, self.key, self.buckets, self.words = spark, path, key, buckets, words
        self.schema = schema
        if not exists(spark, path):
            spark.createDataFrame([], schema).write.parquet(path)
            spark.createDataFrame([], "bucket int, word int, bits long").write.parquet(self._filters)

    @property
    def _filters(self) -> str:
        return f"{self.path}/_filters/words"

    @property
    def rows(self) -> DataFrame:
        """The rows and their bucket."""
        return self.spark.read.schema(StructType([*self.schema.fields]).add("bucket", IntegerType())).parquet(self.path)

    def _words(self) -> DataFrame:
        return self.spark.read.schema("bucket int, word int, bits long").parquet(self._filters)

    def _with_place(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns(dict(zip(("_bucket", "_word", "_mask"), _placed(F.col(self.key), self.buckets, self.words), strict=True)))

    def suspects(self, keys: DataFrame) -> DataFrame:
        """The keys (a column of the key's name) that may be stored, with their bucket."""
        asked = self._with_place(keys.select(self.key).where(F.col(self.key).isNotNull()))
        words = self._words().withColumnsRenamed({"bucket": "_bucket", "word": "_word"}).groupBy("_bucket", "_word").agg(F.bit_or("bits").alias("_bits"))
        return asked.join(words, ["_bucket", "_word"]).where(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).select(self.key, F.col("_bucket").alias("bucket"))

    def held(self, keys: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """The rows of these keys (the key and `columns`); only buckets that may hold one are read."""
        return self._held(Stored(self.suspects(keys).distinct()), columns or [])

    def _held(self, suspects: Stored, columns: list[str]) -> DataFrame:
        hit = [r.bucket for r in suspects.rows.select("bucket").distinct().collect()]  # as many as there are buckets at most
        return self.rows.where(F.col("bucket").isin(hit)).select(self.key, *columns).join(suspects.rows.select(self.key), self.key, "left_semi")

    def add(self, incoming: DataFrame, order: list[str]) -> DataFrame:
        """Appends the first row in `order` of each key that is not stored; returns what was added."""
        own = [f.name for f in self.schema]
        first = incoming.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min_by(F.struct(*own), F.struct(*order)).alias("_row")).select("_row.*")
        fresh = Stored(first)
        suspects = Stored(self.suspects(fresh.rows))
        new = Stored(self._with_place(fresh.rows.join(self._held(suspects, []), self.key, "left_anti")))
        fresh.drop()
        suspects.drop()
        bits = new.rows.groupBy(F.col("_bucket").alias("bucket"), F.col("_word").alias("word")).agg(F.bit_or("_mask").alias("bits"))
        bits.sortWithinPartitions("bucket", "word").write.mode("append").parquet(self._filters)
        added = new.rows.select(*own, F.col("_bucket").alias("bucket"))
        added.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        return added.drop("bucket")

    def compact(self) -> None:
        """One file for each bucket, and its filter anew from its rows; nobody reads or writes meanwhile."""
        fresh, old = f"{self.path}.next", f"{self.path}.old"
        self.rows.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(fresh)
        placed = self._with_place(self.rows)
        words = placed.groupBy(F.col("_bucket").alias("bucket"), F.col("_word").alias("word")).agg(F.bit_or("_mask").alias("bits"))
        words.repartitionByRange("bucket").sortWithinPartitions("bucket", "word").write.parquet(f"{fresh}/_filters/words")
        rename(self.spark, self.path, old)
        rename(self.spark, fresh, self.path)
        delete(self.spark, old)
