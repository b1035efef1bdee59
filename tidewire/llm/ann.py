"""Nearest neighbours by multi-index hashing.

Codes are the signs of learned rotations: principal axes turned by iterative quantisation, fitted on a
bounded sample (SAMPLE distinct vectors, least by hash), as many turns as BITS needs. Every distinct
vector is indexed: codes are split into 8-bit substrings with a posting list for each value. A code
within Hamming distance R of a query has, by pigeonhole, some substring within its share of R, so
probing the values within that share in each list retrieves every such code; the survivors of the exact
Hamming test are ranked by inner product in double precision on the original vectors. R is the TARGET
quantile of distances from the sample's vectors to their true neighbours in the sample, which are
further away than in the whole table, or, if that is more, from ASKED of the queries (least by hash) to their true
neighbours among all rows: a few long vectors that the sample lacks may be everyone's nearest. A query with fewer than min(k, candidates) rows within R (an
outlier, a small table) goes through all blocks again, by inner product alone.

Equal vectors are one entry with their least ids (as many as an answer can hold), so a vector with a
third of all rows costs one. The index is dealt into blocks by hash, the stated query set too, and each
pair of blocks is probed in one task; a query's best of each block are merged.

Vectors that are null, zero, of another dimension than the commonest, or that hold null or non-finite
components take no part. Ties go to the smaller id. Equal rows (id and vector) are one candidate, and a query
each; rows with one id and different vectors are candidates of their own, none of them for a query with that
id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import Stored, cut_lineage, ship, table

K, EVERY = 20, 20
BITS, SAMPLE, TARGET, ASKED = 128, 3000, 0.985, 256
INDEX_BLOCK, QUERY_BLOCK = 8192, 1024
#: Parts that the ids of one vector are dealt into.
PARTS = 32

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: _NEAR[r][v]: which of 256 values are within r bits of v.
_NEAR = _POP[np.arange(256)[:, None] ^ np.arange(256)[None, :]][None] <= np.arange(-1, 9)[:, None, None]


class Coder:
    """Rotated binary codes, the radius and each substring's share of it."""

    def __init__(self, sample: np.ndarray, k: int = K, bits: int = BITS, target: float = TARGET, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        centred = sample - self.mean
        axes = np.linalg.svd(centred, full_matrices=False)[2].T[:, :bits] if len(sample) >= sample.shape[1] else np.eye(sample.shape[1])[:, :bits]
        flat, turns = centred @ axes, []
        while sum(t.shape[1] for t in turns) < bits:
            turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
            for _ in range(25):  # iterative quantisation: the turn that brings the points nearest to their signs
                u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
                turn = (u @ v).T
            turns.append(axes @ turn)
        self.planes = np.hstack(turns)[:, :bits]
        codes = self.codes(sample)
        few = min(len(sample), 512)
        near = sample[:few] @ sample.T
        near[np.arange(few), np.arange(few)] = -np.inf
        best = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
        gaps = _POP[codes[:few, None, :] ^ codes[best]].sum(2, dtype=np.int64)
        self.reach(int(np.ceil(np.quantile(gaps, target))) if gaps.size else bits)

    def reach(self, radius: int) -> None:
        self.radius, subs = radius, self.planes.shape[1] // 8
        spare = radius - subs + 1  # shares that add up to this leave no code within the radius unseen
        self.shares = [max(-1, spare // subs + (j < spare % subs)) for j in range(subs)]

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.planes >= 0, axis=1)


class MultiIndex:
    """Posting lists by substring value over one block of codes."""

    def __init__(self, coder: Coder, vectors: np.ndarray):
        self.coder, self.vectors, self.codes = coder, vectors, coder.codes(vectors)
        self.lists = [np.argsort(c, kind="stable") for c in self.codes.T]
        self.counts = [np.bincount(c, minlength=256) for c in self.codes.T]

    def within(self, code: np.ndarray) -> np.ndarray:
        """Positions of all codes within the radius."""
        seen = np.zeros(len(self.codes), bool)
        for j, share in enumerate(self.coder.shares):
            if share >= 0:
                seen[self.lists[j][np.repeat(_NEAR[min(share, 8) + 1][code[j]], self.counts[j])]] = True
        found = np.flatnonzero(seen)
        return found[_POP[self.codes[found] ^ code].sum(1, dtype=np.int64) <= self.coder.radius]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    v = F.col("v")
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    out = out.where(F.coalesce(fine, F.lit(False)))
    common = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return out.where(F.size("v") == (common.n if common else 0))


def nearest(vectors: DataFrame, queries, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """queries: a condition on vec_id. query_id, rank, vec_id, score of each query's k nearest found."""
    spark = ship(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    stored = Stored(rows.distinct())
    distinct = stored.rows
    same = distinct.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0
    most = k + same  # what an answer is taken from: of these, `same` at most have the query's own id
    # least ids of equal vectors, in two steps, as one vector may have a third of all rows
    part, first = Window.partitionBy("v", "part").orderBy("vec_id"), Window.partitionBy("v").orderBy("vec_id")
    least = distinct.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))).withColumn("n", F.row_number().over(part)).where(F.col("n") <= most)
    least = least.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    index = cut_lineage(least.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    stored.drop()
    asked = rows.where(queries)
    questions = cut_lineage(asked.groupBy("v").agg(F.min("vec_id").alias("q")))
    sample = np.array([r.v for r in index.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()])
    result = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], result)
    made = Coder(sample, k)
    coder = spark.sparkContext.broadcast(made)
    index_blocks = max(1, -(-index.count() // INDEX_BLOCK))
    total = index.agg(F.sum(F.size("ids"))).first()[0]  # no more than `most` of equal vectors

    def best_of(score: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, float]]:
        if len(found) > most:  # all that tie with the last stay in
            some = score >= np.partition(score, -most)[-most]
            found, score = found[some], score[some]
        for i in np.lexsort((found, -score))[:most]:
            yield found[i], float(score[i])

    def prober(exact: bool):
        def probe(block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(block) and len(asking):
                block = block.assign(least=block["ids"].map(lambda i: i[0])).sort_values("least", ignore_index=True)
                vectors, points = np.stack(block["v"].to_numpy()), np.stack(asking["point"].to_numpy())
                multi = None if exact else MultiIndex(coder.value, vectors)
                own = coder.value.codes(vectors) if exact else multi.codes
                for q, point, code in zip(asking["q"], points, coder.value.codes(points), strict=True):
                    found = np.arange(len(vectors)) if exact else multi.within(code)
                    for i, score in best_of(vectors[found] @ point, found):
                        out.append((q, block["ids"][i], score, int(_POP[own[i] ^ code].sum())))
            return pd.DataFrame(out, columns=["q", "ids", "score", "gap"])

        return probe

    def dealt(frame: DataFrame, vector: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        # of one type on both sides: equal numbers of two types lie in two partitions, and their blocks never meet
        return frame.select("*", F.pmod(F.xxhash64(vector), F.lit(blocks)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def answered(questions: DataFrame, exact: bool) -> DataFrame:
        """q, found: the `most` best of each question among the vectors within the radius, or among all."""
        query_blocks = max(1, -(-questions.count() // QUERY_BLOCK))
        left = dealt(index, "v", "ib", index_blocks, "qb", query_blocks).groupBy("ib", "qb")
        right = dealt(questions.select("q", F.col("v").alias("point")), "point", "qb", query_blocks, "ib", index_blocks).groupBy("ib", "qb")
        found = left.cogroup(right).applyInPandas(prober(exact), "q long, ids array<long>, score double, gap int")
        best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
        found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)
        flat = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        found = found.select("q", F.explode("ids").alias("vec_id"), "score", "gap").withColumn("n", F.row_number().over(flat)).where(F.col("n") <= most)
        return found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", "gap"))).alias("found"))

    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ASKED).select("v").distinct()
    true = answered(cut_lineage(questions.join(some, "v")), exact=True)
    true = true.select(F.explode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("q")), 1, k)).alias("x")).select("x.gap")
    gaps = [r.gap for r in true.collect()]  # ASKED * k at most
    if gaps and (radius := int(np.ceil(np.quantile(gaps, TARGET)))) > made.radius:
        made.reach(radius)
        coder = spark.sparkContext.broadcast(made)
    answers = cut_lineage(answered(questions, exact=False))
    whole = answers.where(F.size("found") >= min(most, total))
    lacking = cut_lineage(questions.join(whole, "q", "left_anti"))
    answers = answers if lacking.isEmpty() else whole.unionByName(answered(lacking, exact=True))
    named = asked.join(questions, "v").select(F.col("vec_id").alias("query_id"), "q").join(answers, "q")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = named.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
