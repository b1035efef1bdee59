"""What the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.storage import Stored, arrow_rows, cut_lineage  # noqa: F401

ROOT = str(Path(__file__).resolve().parents[2])

#: Rows and bytes that a mapper turns into Python objects at once; a larger row goes alone.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def sliced(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and, but for a single row, `size` bytes; an empty batch as it is."""
    for batch in batches:
        at = 0
        while at < max(1, batch.num_rows):
            k = min(rows, max(1, batch.num_rows - at))
            while k > 1 and batch.slice(at, k).nbytes > size:
                k = -(-k // 2)
            yield batch.slice(at, k)
            at += k


def over_texts(make: Callable[[list], list], kind: str) -> Callable[..., Column]:
    """A function of a text column: make() gets lists of texts as sliced() bounds them, whatever the session's batches are. kind: boolean or string."""
    arrow = {"boolean": pa.bool_(), "string": pa.string()}[kind]

    def run(texts):
        parts = [pa.array(make(part.column(0).to_pylist()), arrow) for part in sliced([pa.RecordBatch.from_arrays([texts], names=["text"])])]
        return pa.concat_arrays(parts)

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)


def free_name(df: DataFrame, name: str) -> str:
    """A name that none of the columns begins with, whatever their case."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# Vectorised word and shingle hashes ---------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += np.uint64(32)
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_ODD, 1 << 14), _powers(_INV, 1 << 14)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, breaks: np.ndarray = _SPACE) -> np.ndarray:
    """64-bit hashes of the words between breaking bytes, A-Z lower-cased: a polynomial of the bytes and the length, mixed."""
    global _UP, _DOWN
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~breaks[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    while len(_UP) <= len(raw):
        _UP, _DOWN = _powers(_ODD, 2 * len(_UP)), _powers(_INV, 2 * len(_DOWN))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOW[raw] + np.uint64(1)) * _UP[: len(raw)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


_SEATS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3)]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of fewer words, the whole sequence as one; of none, empty."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    total = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        total += mix(words[i : n - k + 1 + i] ^ _SEATS[i % 8]) * _SEATS[(i + 3) % 8] * np.uint64(2 * i + 1)
    return np.unique(mix(total))
