"""A corpus pipeline of five stages: toxic documents go, one document of each near-duplicate group stays, documents with benchmark items go, personal data is redacted, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs; all but the last keep the columns of documents, and further ones whatever their
names. Nulls: a null text is kept by every stage and packed as an end id. Ties and repeated rows: of the rows of a
component the least id stays, of repeated rows (equal id and equal word set) one. Very long texts go through whole.
An empty table gives no rows. Texts reach Python in slices bounded by rows and bytes; stages run in sessions of their own, so no setting of the caller's changes. run() deletes each stage's folder once the next one is written; the last one stays
until the driver ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import decontamination, ngram_join, packing, pii, toxicity
from tidewire.llm.common import BATCH_ROWS, Stored, ship, table

#: What the stages' own sessions set: a model, a batch of texts and what is written share an executor.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.parquet.columnarReaderBatchSize": str(BATCH_ROWS)}


def in_own_session(spark: SparkSession, docs: DataFrame) -> tuple[SparkSession, DataFrame]:
    """docs in a session with the settings of spark and SETTINGS, so that the caller's session keeps its own."""
    if all(spark.conf.get(k) == v for k, v in SETTINGS.items()):
        return ship(spark), docs
    own, name = ship(spark).newSession(), f"docs_{uuid.uuid4().hex}"
    for key, value in (spark.conf.getAll | SETTINGS).items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    docs.createGlobalTempView(name)
    moved = own.table(f"global_temp.{name}")
    spark.catalog.dropGlobalTempView(name)
    return own, moved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below 0.5 stay; it learns from the labelled ones among docs."""
    spark, docs = in_own_session(spark, docs)
    return toxicity.without_toxic(docs, toxicity.fit_grammar(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component stays; documents without words all stay."""
    spark, docs = in_own_session(spark, docs)
    return ngram_join.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark, docs = in_own_session(spark, docs)
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark, docs = in_own_session(spark, docs)
    return pii.redacted(docs, pii.fit_selector(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark, docs = in_own_session(spark, docs)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact_pii),
    ("packing", pack),
]

#: Learned scores, floating-point trees and byte-pair ids have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(ship(spark), sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            stored = Stored(docs)
            docs = stored.rows
            if before:
                before.drop()
            before = stored
    return docs
