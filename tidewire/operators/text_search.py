"""Text search by BM25: a bag of words for each text, and blocks of postings that meet the stated queries.

A text's words are counted in its row, so nothing is shuffled for the index. A search takes the postings of the words asked for, deals
them by text into blocks of a bounded size, and scores each block against each block of queries in one task: scores are summed
there, and only a query's k best of each block leave it. So what is shuffled grows with the postings and with the
answers of blocks, not with the pairs of queries and texts that share a word. No word and no row is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.plans.storage import Stored

K1, B = 1.2, 0.75
#: Scores are compared to this many decimals, so that the order of a sum decides nothing.
DIGITS = 9
#: Postings of a block of texts, nearly, and queries of a block.
BLOCK_POSTINGS, BLOCK_QUERIES = 2_000_000, 16_384


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores, of two characters or more, as often as they stand."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)")), lambda w: F.length(w) > 1)


@dataclass
class Index:
    """bags: id, length, tokens, times (of each token); terms: term, df, idf, most (that a posting of it weighs); texts have `mean` words."""

    bags: Stored
    terms: Stored
    mean: float

    def drop(self) -> None:
        self.bags.drop()
        self.terms.drop()


def _part(mean: float) -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))


def _flat(bags: DataFrame) -> DataFrame:
    """id, length, term, tf."""
    return bags.select("id", "length", F.explode(F.arrays_zip("tokens", "times")).alias("x")).select("id", "length", F.col("x.tokens").alias("term"), F.col("x.times").alias("tf"))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The words of docs, whole texts, counted; a text without words counts towards the mean length."""
    listed = docs.select(F.col(id_col).alias("id"), F.sort_array(words(F.col(text_col))).alias("words"))
    # where a run of equal words starts, by place from 0
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1)))
    runs = listed.select("id", "words", F.size("words").alias("length"), F.when(F.size("words") > 0, starts).otherwise(F.array().cast("array<int>")).alias("starts"))
    ends = F.transform("starts", lambda i, k: F.coalesce(F.get("starts", k + 1), F.col("length")) - i)
    held = Stored(runs.select("id", "length", F.transform("starts", lambda i: F.get("words", i)).alias("tokens"), ends.alias("times")))
    n, mean = held.rows.agg(F.count("*"), F.avg("length")).first()
    mean = mean or 1.0
    terms = _flat(held.rows).groupBy("term").agg(F.count("*").alias("df"), F.max(_part(mean)).alias("most"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return Index(held, Stored(terms.select("term", "df", idf.alias("idf"), (idf * F.col("most")).alias("most"))), mean)


def search(found: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score, rank over queries (query_id, terms: an array): each query's k best, ties to the smaller id. A query's own repeated terms count once."""
    asked = Stored(queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")))
    terms = Stored(found.terms.rows.join(asked.rows.select("term").distinct(), "term").withColumn("no", F.monotonically_increasing_id()))
    postings, n_asked = terms.rows.agg(F.sum("df")).first()[0] or 0, asked.rows.select("query_id").distinct().count()
    blocks, query_blocks = max(1, -(-postings // BLOCK_POSTINGS)), max(1, -(-n_asked // BLOCK_QUERIES))
    lists = _flat(found.bags.rows).join(terms.rows, "term").select("id", "no", (F.col("idf") * _part(found.mean)).alias("weight"))

    def best(postings: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0)})]
        if len(postings) and len(wanted):
            ids, place = np.unique(postings["id"].to_numpy(), return_inverse=True)
            order = np.argsort(postings["no"].to_numpy(), kind="stable")
            place, weights = place[order], postings["weight"].to_numpy()[order]
            held, start = np.unique(postings["no"].to_numpy()[order], return_index=True)
            end = np.append(start[1:], len(order))
            wanted = wanted[wanted["wanted"].isin(held)].sort_values(["query_id", "wanted"])
            at = np.searchsorted(held, wanted["wanted"].to_numpy())
            asking, first = np.unique(wanted["query_id"].to_numpy(), return_index=True)
            for q, own in zip(asking, np.split(at, first[1:]), strict=True):
                score, hit = np.zeros(len(ids)), np.zeros(len(ids), bool)
                for t in own:  # a text stands in a list once
                    score[place[start[t]:end[t]]] += weights[start[t]:end[t]]
                    hit[place[start[t]:end[t]]] = True
                few = np.flatnonzero(hit)
                if len(few) > k:
                    few = few[score[few] >= np.partition(score[few], -k)[-k] - 2 * 10.0**-DIGITS]
                score = np.round(score[few], DIGITS)
                top = np.lexsort((ids[few], -score))[:k]
                out.append(pd.DataFrame({"query_id": q, "id": ids[few[top]], "score": score[top]}))
        return pd.concat(out)

    def dealt(frame: DataFrame, key: str, own: str, n: int, other: str, others: int) -> DataFrame:
        # of one type on both sides: equal numbers of two types lie in two partitions
        return frame.select("*", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)).groupBy("block", "queries")

    left = dealt(lists, "id", "block", blocks, "queries", query_blocks)
    right = dealt(asked.rows.join(terms.rows.select("term", F.col("no").alias("wanted")), "term").select("query_id", "wanted"), "query_id", "queries", query_blocks, "block", blocks)
    scored = left.cogroup(right).applyInPandas(best, "query_id long, id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = Stored(scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k))
    terms.drop()
    asked.drop()
    return out.rows


def fused(knn: DataFrame, fts: DataFrame, k: int, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """query_id, id, score, cosine: each query's k best by reciprocal ranks of knn (query_id, id, cosine, rank) and fts (query_id, id, rank), ties to the smaller id."""
    a = knn.select("query_id", "id", "cosine", F.col("rank").alias("ra"))
    b = fts.select("query_id", "id", F.col("rank").alias("rb"))
    score = F.coalesce(weights[0] / F.col("ra"), F.lit(0.0)) + F.coalesce(weights[1] / F.col("rb"), F.lit(0.0))
    out = a.join(b, ["query_id", "id"], "full_outer").select("query_id", "id", score.alias("score"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "id")
    return out.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
