"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold[k] - w.x) with rising thresholds and one weight vector shared by
all grades. x holds hashed features of the whole text: its words, the shapes of its words, and ranges
of document figures (repetition, symbols, capitals, length). The score is the expected grade; the
tail probability P(grade >= TAIL) selects.

Grades of the query: 0 low quality; 1 good quality but toxic; 2 good quality. Fitted on at most
TRAIN_DOCS labelled rows, those least by a hash of the id, by AdaGrad on the driver; then every whole
text is scored. Nulls are empty texts. Without ratings every document gets the same middle score.
Equal texts have equal scores, so ties are kept; rows with one id are scored each by itself, and teach once, by the least
text and the least grade of the id. Very long texts go through whole; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import ship, sliced, table, word_hashes

TRAIN_DOCS = 6000
BUCKETS = 1 << 16
#: Grades from here on count as the tail, and a document with at least SELECT of its probability there is selected.
TAIL, SELECT = 1, 0.5
_SHAPES, _FIGURES = 256, 160

#: Byte classes as bits: lower, upper, digit, sentence marks, loud marks, symbols, bars and brackets, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 128
for _chars, _bit in ((b".,;:'\"-", 8), (b"!?", 16), (b"#$%&*@^~+=\\", 32), (b"|<>{}[]()/_`", 64)):
    _CLASS[list(_chars)] = _bit
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices below BUCKETS + _SHAPES + _FIGURES, and values."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words = word_hashes(text or "")
    n = len(words)
    if not n:
        return np.array([BUCKETS + _SHAPES]), np.array([1.0])
    inside = ~_SPACE[raw]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    shapes = np.bitwise_or.reduceat(np.where(inside, _CLASS[raw], 0), starts)
    buckets, counts = np.unique((words % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    kinds, many = np.unique(shapes, return_counts=True)
    lengths = np.diff(np.append(starts, len(raw)))
    again = float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0
    figures = [
        again, len(np.unique(words)) / n, float((shapes & 2 > 0).mean()), float((shapes & 16 > 0).mean()),
        float((shapes & 32 > 0).mean()), float((shapes & 64 > 0).mean()), float((shapes & 4 > 0).mean()), min(1.0, float(lengths.mean()) / 16), min(1.0, np.log2(n + 1) / 16),
        float((raw == 10).sum()) / n, counts.max() / n,
    ]
    # each figure lights one of twelve ranges, finer near nought
    ranges = [1 + 12 * i + min(11, int(12 * min(1.0, max(0.0, f)) ** 0.5)) for i, f in enumerate(figures)]
    index = np.concatenate([buckets, BUCKETS + kinds.astype(np.int64), np.array(ranges) + BUCKETS + _SHAPES])
    value = np.concatenate([counts / n, np.sqrt(many / n), np.ones(len(ranges))])
    return index, value


class CumulativeLink:
    """Shared weights and ordered thresholds."""

    def __init__(self, grades: int, size: int = BUCKETS + _SHAPES + _FIGURES):
        self.weights = np.zeros(size)
        self.low, self.steps = 0.0, np.zeros(max(0, grades - 2))  # thresholds: low, then positive steps exp(steps)

    @property
    def thresholds(self) -> np.ndarray:
        return self.low + np.concatenate([[0.0], np.cumsum(np.exp(self.steps))])

    def above(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k below the highest grade."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[index] @ value, -30, 30)))

    def gradients(self, rows: Rows, some: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Of the rows in `some`: the log-likelihood, and its gradients by the weights and by (low, steps)."""
        at, own = rows.entries(some)
        index, value, grade = rows.index[at], rows.value[at], rows.grade[some]
        score = np.bincount(own, value * self.weights[index], len(some))
        # the likelihood of a grade lies between two ends; the lowest and the highest grade have one
        ends = np.concatenate([[-np.inf], self.thresholds, [np.inf]])
        below, under = (1 / (1 + np.exp(-np.clip(ends[grade + k] - score, -30, 30))) for k in (1, 0))
        below, under = np.where(grade == len(ends) - 2, 1.0, below), np.where(grade == 0, 0.0, under)
        mass = np.maximum(below - under, 1e-6)
        d_below, d_under = below * (1 - below) / mass, under * (1 - under) / mass
        by_weight = np.bincount(index, ((d_under - d_below)[own]) * value, len(self.weights))
        pull = (np.bincount(grade + 1, d_below, len(ends)) - np.bincount(grade, d_under, len(ends)))[1:-1]
        return float(np.log(mass).sum()), by_weight, np.append(pull.sum(), np.cumsum(pull[::-1])[::-1][1:] * np.exp(self.steps))

    def fit(self, rows: Rows, epochs: int = 12, rate: float = 0.3, ridge: float = 1e-5, seed: int = 7, batch: int = 16) -> CumulativeLink:
        """Maximum likelihood by AdaGrad over batches of rows, in an order that the seed fixes."""
        rng = np.random.default_rng(seed)
        square, square_t = np.full(len(self.weights), 1e-4), np.full(1 + len(self.steps), 1e-2)
        if not len(rows.grade):
            return self
        share = np.clip([np.mean(rows.grade <= k) for k in range(len(self.steps) + 1)], 0.01, 0.99)
        cut = np.maximum.accumulate(np.log(share / (1 - share)) + 0.05 * np.arange(len(share)))
        self.low, self.steps = float(cut[0]), np.log(np.maximum(np.diff(cut), 0.05))
        for _ in range(epochs):
            order = rng.permutation(len(rows.grade))
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                _, step, move = self.gradients(rows, some)
                met = np.flatnonzero(step)
                step = step[met] - ridge * len(some) * self.weights[met]
                square[met] += step**2
                self.weights[met] += rate * step / np.sqrt(square[met])
                square_t += move**2
                move = 0.1 * move / np.sqrt(square_t)
                self.low, self.steps = self.low + move[0], np.clip(self.steps + move[1:], -6, 4)
        return self


class Rows:
    """Sparse rows one after the other, and their grades."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]]):
        self.grade = np.array([g for _, _, g in rows], np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(i) for i, _, _ in rows])]).astype(np.int64)
        self.index = np.concatenate([i for i, _, _ in rows]) if rows else np.empty(0, np.int64)
        self.value = np.concatenate([v for _, v, _ in rows]) if rows else np.empty(0)

    def entries(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some rows, and which of these rows each belongs to."""
        sizes = self.starts[some + 1] - self.starts[some]
        own = np.repeat(np.arange(len(some)), sizes)
        return np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes - self.starts[some], sizes), own


def fit_quality(docs: DataFrame, ratings: DataFrame, grades: int = 3, train_docs: int = TRAIN_DOCS) -> CumulativeLink:
    """docs: doc_id, text; ratings: doc_id, grade (0 to grades - 1; others are left out)."""
    ship(docs.sparkSession)
    lot = ratings.where(F.col("grade").between(0, grades - 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").cast("long").alias("grade"))
    lot = lot.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.int32).tobytes() for i, _ in made], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary()), batch.column(2)], names=["doc_id", "i", "v", "grade"])

    rated = docs.select("doc_id", "text").join(F.broadcast(lot), "doc_id").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), "grade")
    rated = rated.groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("doc_id", "text", "grade")  # of an id's rows the least text
    rows = sorted(tuple(r) for r in rated.mapInArrow(run, "doc_id long, i binary, v binary, grade long").collect())
    return CumulativeLink(grades).fit(Rows([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(float), g) for _, i, v, g in rows]))


def score_quality(docs: DataFrame, model: CumulativeLink, id_col: str = "doc_id", text_col: str = "text", tail: int = TAIL) -> DataFrame:
    """id, expected_grade, tail_prob (of a grade of at least `tail`)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            above = np.array([model.above(*features(t)) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1), pa.float64()), pa.array(above[:, tail - 1], pa.float64())], names=[id_col, "expected_grade", "tail_prob"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, expected_grade double, tail_prob double")


def graded(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2).alias("grade"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, graded(table(spark, sf_dir, "labels")))
    return score_quality(docs, model).withColumn("selected", F.col("tail_prob") >= SELECT)
