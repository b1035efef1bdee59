"""Token counts by a map-side lookup of two tiers.

The vocabulary file takes a text as independent pre-tokens, so a text's count is the sum of its pre-tokens'
lengths. One scan of all texts finds the FREQUENT commonest pre-tokens by mergeable sketches of bounded size, which
meet in two steps; their lengths are encoded once and broadcast as one string and one byte array. The second scan
looks up each pre-token where its text lies; what the table lacks is encoded and kept in the worker's own bounded
cache. No pre-token is shuffled, and the table decides the time alone, never a count.

Pre-tokens of PLAIN characters come from the vocabulary's own pattern over lower-cased text, which equals the file's
normaliser there; a word of other characters (combining marks and the like) goes to the tokenizer whole.
A special string inside a text is one token, as the library's default has it.

Nulls and empty texts have no tokens and no bytes. Rows with a null or repeated doc_id are documents of their own.
Very long texts are walked lazily, very long words are encoded whole and not kept. An empty table gives no rows.
Columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from tidewire.llm.common import ship, sliced, table

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
#: Entries of the broadcast table, what a sketch tracks, and the longest pre-token that is kept.
FREQUENT, TRACKED, KEPT_CHARS = 32_768, 65_536, 48
#: Sketches of the scan's tasks meet in so many groups before the last one.
LANES = 64
#: Entries of a worker's cache.
CACHED = 1 << 17
#: The file's special strings and its pre-token pattern.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that are their own composed form beside any of the others, and are lower-cased one by one.
PLAIN = r"\x00-˿Ѐ-҂‐-‧ぁ-ゖァ-ヺ一-龥"

_find = regex.compile(PRE_TOKEN)
_odd = regex.compile(f"[^{PLAIN}]")
_special = regex.compile("|".join(map(regex.escape, SPECIAL)))
_blank = regex.compile(r"[\t\n\x0b\x0c\r ]+")
#: Texts of more characters are walked instead of listed.
LISTED = 1 << 20


@lru_cache(4)
def tokenizer(path: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))


@lru_cache(4)
def _model(path: str | None):
    return tokenizer(path).model


_bytes = ByteLevel(add_prefix_space=False, use_regex=False)


def encoded_length(piece: str, path: str | None = None) -> int:
    """Of a pre-token, by the vocabulary's merges alone."""
    spelled = piece if piece.isascii() and piece.isprintable() else _bytes.pre_tokenize_str(piece)[0][0]
    return len(_model(path).tokenize(spelled))


class Lengths(dict):
    """Lengths of frequent pre-tokens; others are encoded, and short ones kept beside them until CACHED are: the second tier, which then begins anew."""

    def __init__(self, pieces: str, lengths: bytes, path: str | None = None):
        super().__init__(zip(pieces.split("\n"), lengths, strict=True) if pieces else ())
        self.path, self.frequent, self.room = path, None, CACHED

    def __missing__(self, piece: str) -> int:
        n = encoded_length(piece, self.path)
        if len(piece) <= KEPT_CHARS:
            if self.frequent is None:
                self.frequent = dict(self)
            if not self.room:
                self.clear()
                self.update(self.frequent)
                self.room = CACHED
            self[piece] = n
            self.room -= 1
        return n

    def _plain(self, text: str) -> int:
        low = text.lower()
        if len(low) <= LISTED:
            return sum(map(self.__getitem__, _find.findall(low)))
        return sum(self[m.group()] for m in _find.finditer(low))

    def _stretch(self, text: str) -> int:
        if not _odd.search(text):
            return self._plain(text)
        plain, n = [], 0
        for word in _blank.splititer(text):
            if _odd.search(word):
                n += len(tokenizer(self.path).encode(word, add_special_tokens=False))
            else:
                plain.append(word)
        return n + self._plain(" ".join(plain))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" not in text:
            return self._stretch(text)
        stretches = _special.split(text)
        return len(stretches) - 1 + sum(map(self._stretch, stretches))


@lru_cache(1)
def lengths_of(known: Broadcast, path: str | None) -> Lengths:
    """The worker's table, kept from task to task."""
    return Lengths(*known.value, path)


def frequent_lengths(docs: DataFrame, path: str | None = None, most: int = FREQUENT) -> tuple[str, bytes]:
    """The commonest pre-tokens of all texts, by line, and their lengths; at most `most` entries of at most KEPT_CHARS characters."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(PRE_TOKEN), F.lit(0)))
    sketches = (
        docs.select(F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("lane"), words.alias("word")).where(F.length("word") <= KEPT_CHARS)
        .groupBy("lane").agg(F.expr(f"approx_top_k_accumulate(word, {TRACKED})").alias("sketch"))
    )
    # grouped, as there is nothing to combine without rows
    found = sketches.withColumn("all", F.lit(True)).groupBy("all").agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch")).select(F.expr(f"approx_top_k_estimate(sketch, {most})").alias("top")).first()
    pieces = [x.item for x in found.top if x.item] if found and found.top else []
    sized = [(p, n) for p in pieces if "\n" not in p and (n := encoded_length(p, path)) < 256]
    return "\n".join(p for p, _ in sized), bytes(n for _, n in sized)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text); path: a file of the same normaliser and pattern."""
    spark = ship(docs.sparkSession)
    known = spark.sparkContext.broadcast(frequent_lengths(docs, path, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = lengths_of(known, path)
        for batch in sliced(batches):
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n_tokens = np.fromiter((lengths.count(t) for t in texts.to_pylist()), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
