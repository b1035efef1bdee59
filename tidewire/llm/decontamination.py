"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Text is compared in words (runs of letters, digits and bytes beyond ASCII, A-Z lower-cased). A stretch of
a text is a copy of the item when their edit distance in words is at most TOLERANCE of the item's words.

1. Places worth a look: an item of n words and a copy of it with k edits share all but 2k of the item's
   pairs of neighbouring words. Stretches of n + k words with fewer of its pairs are passed over; this
   loses no copy, nor does passing over texts that lack more than 2k of its different pairs (as those that
   repeat one do). Of the rest, the windows of n words with as many of its pairs are embedded.
2. CGK random walks map a window to a string in which a copy of the item differs in few places: a walk
   writes its current word and moves on, or stays, by a random bit of the step and the word.
3. Bit sampling: each table keys a walk by PLACES of its places; an item is a candidate of a window that
   shares a key with it. WALKS and TABLES are set for a recall above 0.99 of substitutions at the
   tolerance (see tests).
4. Exact edit distance of the best-fitting stretch decides: around the candidates first, and over all places
   of step 1 for an item that is not found there (inserted and dropped words shift the windows).

Items are searched for in blocks of at most BLOCK_ITEMS with ITEM_WORDS words each on average, so what
each task gets is bounded however many there are. Items without words match nothing; items of one word
match that word. Null and empty texts match nothing. Repeated rows are searched one by one; repeated
items each give a row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import mix, over_texts, ship, sliced, table, word_hashes

TOLERANCE = 0.2
WALKS, TABLES, PLACES = 5, 10, 2
BLOCK_ITEMS, ITEM_WORDS = 2048, 256
#: Windows judged together, and cells (steps of a walk) embedded at once.
LOT, CELLS = 8192, 1 << 22
#: Windows of one item's places that are embedded, about: of a long item, every n / WINDOWS-th, which such few words shift little.
WINDOWS = 128

_BREAKS = np.ones(256, bool)
_BREAKS[48:58] = _BREAKS[65:91] = _BREAKS[97:123] = _BREAKS[128:] = False


def words_of(text: str | None) -> np.ndarray:
    return word_hashes(text or "", _BREAKS)


def allowed(n: int, tolerance: float = TOLERANCE) -> int:
    """Most edits in a copy of n words."""
    return int(n * tolerance + 1e-9)


def _pairs(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ mix(words[1:]))


def keys(windows: np.ndarray, sizes: np.ndarray, walks: int = WALKS, tables: int = TABLES, places: int = PLACES) -> np.ndarray:
    """A row of walks * tables keys for each word sequence; rows are filled up with noughts beyond their size.

    A walk of 3n steps over n words writes its current word and moves on if the highest bit of the word's product with the step's odd number is set.
    """
    count, width = windows.shape
    padded = np.hstack([windows, np.zeros((count, 1), np.uint64)])
    rows, out = np.arange(count), []
    for number in range(walks):
        odd = np.random.default_rng(number).integers(1, 1 << 63, 3 * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        at, embedded = np.zeros(count, np.int64), np.empty((3 * width, count), np.uint64)
        for step in range(3 * width):
            word = embedded[step] = padded[rows, at]
            at += ((word * odd[step]) >> np.uint64(63)).view(np.int64)
            np.minimum(at, sizes, out=at)
        found = np.empty((count, tables), np.uint64)
        for n in np.unique(sizes):
            mine = np.flatnonzero(sizes == n)
            rng = np.random.default_rng((int(n), number))
            # the last third of the places may be past the end
            sampled, weights = rng.integers(0, max(1, 2 * n), (tables, places)), rng.integers(1, 1 << 63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            found[mine] = (embedded[sampled[:, :, None], mine] * weights[:, None]).sum(1, dtype=np.uint64).T
        out.append(found)
    return np.concatenate(out, 1)


def keys_of(sequences: list[np.ndarray]) -> np.ndarray:
    """The keys of each sequence, worked out for those of like size together, so that a long one doesn't fill up the others."""
    out = np.empty((len(sequences), WALKS * TABLES), np.uint64)
    sizes = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and sizes[order[stop]] <= 2 * sizes[order[at]] and 3 * sizes[order[stop]] * (stop + 1 - at) <= CELLS:
            stop += 1
        some = order[at:stop]
        out[some] = keys(_stacked([sequences[i] for i in some]), sizes[some])
        at = stop
    return out


def _last_row(windows: np.ndarray, item: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Edit distances of the item to each window's beginnings of each length, where none of the item costs `first`."""
    count, n = windows.shape
    row = np.broadcast_to(first, (count, n + 1)).copy()
    steps = np.arange(n + 1)
    for i, word in enumerate(item):
        change = row[:, :-1] + (windows != word)
        best = np.empty_like(row)
        best[:, 0] = i + 1
        best[:, 1:] = np.minimum(change, row[:, 1:] + 1)
        row = np.minimum.accumulate(best - steps, axis=1) + steps  # inserted words, all at once
    return row


def edit_distances(windows: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Edit distance in words of each window to the item."""
    return _last_row(windows, item, np.arange(windows.shape[1] + 1))[:, -1]


def best_stretch(words: np.ndarray, item: np.ndarray, most: int | None = None) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the words, and the first such stretch's start; beyond `most` edits, no start is looked for."""
    row = _last_row(words[None], item, np.zeros(len(words) + 1, np.int64))[0]
    end = int(row.argmin())
    if most is not None and row[end] > most:
        return int(row[end]), end
    before = words[max(0, end - 2 * len(item)) : end][::-1]  # a longer stretch has more edits than all words of the item
    lengths = np.flatnonzero((back := _last_row(before[None], item[::-1], np.arange(len(before) + 1))[0]) == back.min())
    return int(row[end]), end - int(lengths[np.abs(lengths - len(item)).argmin()])


def _merged(starts: np.ndarray, width: int, size: int) -> list[tuple[int, int]]:
    """Stretches of a text of `size` words that `width` words from each of the rising starts cover."""
    cut = np.flatnonzero(np.diff(starts) > width) + 1
    return [(max(0, int(s[0])), min(size, int(s[-1]) + width)) for s in np.split(starts, cut)]


class Items:
    """A block of items with their LSH keys, and a list of items for each pair of neighbouring words."""

    def __init__(self, items: list[tuple[int, str | None]], tolerance: float = TOLERANCE):
        self.items = [(item_id, w) for item_id, text in items if len(w := words_of(text))]
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.keys = keys_of([w for _, w in self.items])
        self.edits = [allowed(len(w), tolerance) for _, w in self.items]
        self.needed = np.array([len(w) - 1 - 2 * k for (_, w), k in zip(self.items, self.edits, strict=True)], np.int64)
        pairs = [np.unique(_pairs(w)) for _, w in self.items]
        self.kinds = np.array([len(p) - 2 * k for p, k in zip(pairs, self.edits, strict=True)], np.int64)
        flat, owner = np.concatenate([np.empty(0, np.uint64), *pairs]), np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        order = np.argsort(flat, kind="stable")
        self.pairs, first = np.unique(flat[order], return_index=True)
        self.owners, self.bounds = owner[order], np.append(first, len(flat))
        self.single = [i for i, (_, w) in enumerate(self.items) if len(w) == 1]

    def windows(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int]]]]:
        """Items with the starts of windows, and all stretches, that hold as many of their pairs as a copy must."""
        for i in self.single:
            if len(starts := np.flatnonzero(words == self.items[i][1][0])):
                yield i, starts[:1], [(int(starts[0]), int(starts[0]) + 1)]
        if len(words) < 2 or not len(self.pairs):
            return
        pairs = _pairs(words)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        spots = np.flatnonzero(self.pairs[at] == pairs)
        if not len(spots):
            return
        owned = lambda some: [self.owners[self.bounds[j] : self.bounds[j + 1]] for j in some]
        kinds = np.bincount(np.concatenate(owned(np.unique(at[spots]))), minlength=len(self.items))
        if not (kinds >= np.maximum(self.kinds, 1)).any():
            return
        found = owned(at[spots])
        owners, places = np.concatenate(found), np.repeat(spots, [len(x) for x in found])
        counts = np.bincount(owners, minlength=len(self.items))
        for i in np.flatnonzero((counts >= self.needed) & (counts > 0) & (kinds >= self.kinds)):
            n, mine = len(self.items[i][1]), places[owners == i]
            if n == 1 or len(words) < n - self.edits[i]:
                continue
            def holding(width: int, last: int, i=i, mine=mine) -> np.ndarray:
                starts = np.arange(max(0, mine[0] - width + 1), max(0, min(last, mine[-1])) + 1)
                inside = np.searchsorted(mine, starts + width - 1) - np.searchsorted(mine, starts)
                return starts[inside >= self.needed[i]]

            width = n + self.edits[i]
            if len(wide := holding(width, len(words))):
                starts = holding(n, len(words) - n)
                yield int(i), starts[:: max(1, n // WINDOWS)], _merged(wide, width, len(words))

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text: item_id, first word of its best stretch, edits, words of the item; one for each item found."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        lot: list[tuple[int, int, int, np.ndarray]] = []  # text, item, start, window
        places: dict[tuple[int, int], tuple[np.ndarray, list[tuple[int, int]]]] = {}  # text, item: words, stretches
        for k, text in enumerate(texts):
            words = words_of(text)
            for i, starts, stretches in self.windows(words):
                n = len(self.items[i][1])
                # a text shorter than the item is filled up with a word that is none
                padded = np.concatenate([words, np.zeros(max(0, n - len(words)), np.uint64)])
                lot += [(k, i, int(s), padded[s : s + n]) for s in starts]
                places[k, i] = words, stretches
                if len(lot) >= LOT or len(places) >= LOT:  # all of a text's windows of an item are judged together
                    self._judge(lot, places, out)
                    lot, places = [], {}
        self._judge(lot, places, out)
        return out

    def _judge(self, lot: list[tuple[int, int, int, np.ndarray]], places: dict[tuple[int, int], tuple[np.ndarray, list[tuple[int, int]]]], out: list[list[tuple[int, int, int, int]]]) -> None:
        """LSH over all windows at once, then the exact distances around those that share a key with their item, or else of all places."""
        near: dict[tuple[int, int], list[int]] = {}
        if lot:
            owner = np.array([i for _, i, _, _ in lot])
            same = (keys_of([w for *_, w in lot]) == self.keys[owner]).any(1)
            for j in np.flatnonzero(same):
                near.setdefault(lot[j][:2], []).append(lot[j][2])
        for (k, i), (words, stretches) in places.items():
            item_id, item = self.items[i]
            around = _merged(np.array(near[k, i]) - self.edits[i], len(item) + 2 * self.edits[i], len(words)) if (k, i) in near else []
            for some in (around, stretches):
                found = [(edits, a + start) for a, b in some for edits, start in [best_stretch(words[a:b], item, self.edits[i])]]
                edits, start = min(found, default=(len(item), 0))
                if found and edits <= self.edits[i]:
                    out[k].append((item_id, start, edits, len(item)))
                    break


def _stacked(sequences: list[np.ndarray]) -> np.ndarray:
    """Sequences as rows, filled up with noughts."""
    out = np.zeros((len(sequences), max(map(len, sequences))), np.uint64)
    for row, s in zip(out, sequences, strict=True):
        row[: len(s)] = s
    return out


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of bounded size, one at a time on the driver."""
    block, size = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_ITEMS * ITEM_WORDS * 6:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, edits, item_words, similarity: a row for each document and item found in it."""
    spark = ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, item_id long, start_word long, edits long, item_words long"
    found = spark.createDataFrame([], schema)
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(Items(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                rows = [(key, *hit) for key, hits in zip(batch.column(0).to_pylist(), shared.value.search(batch.column(1).to_pylist()), strict=True) for hit in hits]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, (batch.schema.field(0).type, *[pa.int64()] * 4), strict=True)], names=[id_col, "item_id", "start_word", "edits", "item_words"])

        found = found.unionByName(docs.select(id_col, text_col).mapInArrow(run, schema))
    return found.withColumn("similarity", 1 - F.col("edits") / F.col("item_words"))


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows in which no item is found, with the same columns."""
    spark = ship(docs.sparkSession)
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(Items(block))
        clean = over_texts(lambda texts, shared=shared: [not hits for hits in shared.value.search(texts)], "boolean")
        docs = docs.where(clean(text_col))
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
