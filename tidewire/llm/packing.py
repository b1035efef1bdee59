"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

`token_pieces` tokenises every whole text and cuts it: whole windows stay whole, the rest is cut
into pieces small enough for differencing to balance. `pack` deals the pieces into groups of a
bounded number of windows by a hash of (doc_id, start, place in the stored table), so that no document,
source, partition or repeated row makes a large group, and splits each group into near-equal windows; while the fullest window of a
group is over capacity, the group gets another window.

Nulls and empty texts are documents of the end id alone. Rows with the same doc_id are documents of
their own. An empty table gives no rows. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import Stored, ship, sliced, table

WINDOW, END_ID = 2048, 1
#: Fixed value: the token that the tokenizers file adds, which a text may hold.
ADDED = {"<|endoftext|>": 50256}
#: What is left of a document after its whole windows is cut into pieces of at most this many tokens.
PIECE = 512
#: Windows that one task balances at once.
GROUP_WINDOWS = 320

_encodings: dict = {}


def encoding(ranks_path: str | None = None):
    """The byte-level BPE; `ranks_path` names a file of base64 tokens and ranks, of ordinary text only.

    The ids are those of the tokenizers file byte_bpe_50k.json (the same vocabulary as ranks, and the token that the file adds), found faster; the tests hold the two against each other.
    """
    if ranks_path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[ranks_path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={} if ranks_path else ADDED)
    return _encodings[ranks_path]


def slow_encoding():
    """The tokenizers file itself."""
    if "slow" not in _encodings:
        import public_tokenizers
        from tokenizers import Tokenizer

        _encodings["slow"] = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return _encodings["slow"]


def token_ids(text: str | None, ranks_path: str | None = None) -> np.ndarray:
    """Little-endian ids of a text and the end id."""
    try:
        ids = encoding(ranks_path).encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)
    except ValueError:  # tiktoken's pattern runs out of stack on about a million white spaces in a row
        if ranks_path is not None:
            raise
        ids = np.array(slow_encoding().encode(text, add_special_tokens=False).ids, np.uint32)
    return np.append(ids, np.uint32(END_ID)).astype("<u4")


def cuts(n: int, window: int = WINDOW, piece: int = PIECE) -> list[int]:
    """Starts of a document's pieces, and its length."""
    whole = n - n % window
    return [*range(0, whole, window), *range(whole, n, piece), n]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, ranks_path: str | None = None, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(text, ranks_path)
                edges = cuts(len(ids), window, piece)
                rows += [(doc_id, a, b - a, zlib.crc32(ids[a:b]), len(ids)) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def differencing(sizes: np.ndarray, parts: int) -> list[list[int]]:
    """Splits items into `parts` lists of near-equal sums: the two partial partitions with the largest spread are merged, the largest part of one with the smallest of the other, until one partition is left.

    A partial partition is its non-zero part sums in falling order, less the smallest part, and a tree node for each part.
    """
    n = len(sizes)
    if parts == 1:
        return [list(range(n))]
    left, right, idle = [], [], []  # children of node n + i; items in parts that became zero
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = n

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        first = n + len(left)
        left.extend(a.tolist())
        right.extend(b.tolist())
        return np.arange(first, first + len(a))

    while len(heap) > 1:
        _, _, va, na = heapq.heappop(heap)
        _, _, vb, nb = heapq.heappop(heap)
        over = len(va) + len(vb) - parts
        if over <= 0:
            values, nodes = np.concatenate([va, vb]), np.concatenate([na, nb])
        else:  # the smallest of one meet the smallest non-zero of the other, largest with smallest
            ka, kb = len(va) - over, len(vb) - over
            values = np.concatenate([va[:ka], vb[:kb], va[ka:] + vb[kb:][::-1]])
            nodes = np.concatenate([na[:ka], nb[:kb], joined(na[ka:], nb[kb:][::-1])])
        order = np.argsort(-values, kind="stable")
        values, nodes = values[order], nodes[order]
        if len(values) == parts:
            values = values - values[-1]
        heapq.heappush(heap, (-int(values[0] - (values[-1] if len(values) == parts else 0)), turn, values, nodes))
        turn += 1
    lists = []
    for node in heap[0][3].tolist() if heap else []:
        stack, items = [node], []
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += (left[x - n], right[x - n])
        lists.append(sorted(items))
    return lists


def windows(sizes: np.ndarray, capacity: int = WINDOW) -> list[list[int]]:
    """Near-equal windows of at most `capacity`; the count rises from the least possible while one is over it."""
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        parts = differencing(sizes, count)
        if max(int(sizes[p].sum()) for p in parts) <= capacity:
            return parts
        count += 1


def pack(pieces: DataFrame, window: int = WINDOW, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `window` tokens."""
    pieces = Stored(pieces).rows
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, round(total / (group_windows * window)))

    def balance(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "doc_tokens", "ids_crc32"], kind="stable", ignore_index=True, na_position="first")
        sizes = frame["length"].to_numpy()
        whole, rest = np.flatnonzero(sizes == window), np.flatnonzero(sizes < window)
        parts = [[i] for i in whole] + [rest[p] for p in (windows(sizes[rest], window) if len(rest) else []) if len(p)]
        sequence, offset = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
        for k, part in enumerate(parts):
            sequence[part], offset[part] = k, np.cumsum(sizes[part]) - sizes[part]
        return frame.assign(sequence_id=(frame.pop("bucket").to_numpy().astype(np.int64) << 24) + sequence, offset=offset)

    # the place in the stored table deals repeated rows apart; it is the same whenever a task runs again
    bucket = F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)).alias("bucket")
    return pieces.select("*", bucket).groupBy("bucket").applyInPandas(balance, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    return pack(token_pieces(docs, ranks_path))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
