"""Set and vector similarity: token joins without a cap, exact nearest neighbours in blocks, rank fusion.

Sets, words and keys meet in shuffles whatever their size (hint "merge"): they grow with the rows, and what Spark broadcasts goes through the driver, anew in each batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import jaccard, tokens


def title_classes(items: DataFrame, id_col: str = "rowid", text_col: str = "title") -> DataFrame:
    """tokens, class_id, first: one row for each distinct token set with its least id. Copies are one class."""
    rows = items.select(F.array_sort(tokens(F.col(text_col))).alias("tokens"), F.col(id_col).alias("id"))
    return rows.groupBy("tokens").agg(F.min("id").alias("first")).withColumn("class_id", F.col("first"))


def _keyed(sets: DataFrame, over: float, sides: int) -> DataFrame:
    """key, side, class_id, n, pos, short: pairs of a set's rarest words, by which sets (class_id, tokens, side) meet that may have a Jaccard similarity over `over`.

    Words stand in one order, the rarest first. Two sets of n <= m words that share enough of them share two, if not one alone is enough: the second of these has the rest of the
    shared ones behind it in either set, so it is among the first n or m less the least overlap plus two. A larger set shares more with a set of n (`short`) than a smaller one,
    so fewer places are left. One word alone is enough for the smallest sets only; they are also keyed by each. Words that are on fewer than `sides` sides, or in one set, key nothing.
    """
    c, n = over / (1 + over), F.col("n")
    flat = sets.select("side", "class_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    common = flat.groupBy("token").agg(F.count("*").alias("df"), F.count_distinct("side").alias("sides") if sides > 1 else F.lit(1).alias("sides"))
    ranked = flat.join(common.hint("merge"), "token").groupBy("side", "class_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", F.xxhash64("token").alias("word"), "token", "sides"))).alias("words"))
    # the least overlaps, by the same division that decides in the end
    low, low_short = F.floor(over * n), F.floor(2 * c * n)
    ends = [n - low - F.when(low / n > over, 0).otherwise(1) + 2, n - low_short - F.when(low_short / (2 * n - low_short) > over, 0).otherwise(1) + 2]
    placed = F.transform("words", lambda w, i: F.struct((i + 1).alias("pos"), w["word"].alias("word"), ((w["df"] > 1) & (w["sides"] >= sides)).alias("met")))
    first = ranked.select("side", "class_id", "n", ends[0].alias("end"), ends[1].alias("short_end"), placed.alias("words"))
    first = first.withColumn("words", F.filter("words", lambda w: w["met"] & (w["pos"] <= F.col("end"))))
    each = first.select("side", "class_id", "n", "short_end", "words", F.posexplode("words").alias("at", "one"))
    two = F.transform(F.slice("words", F.col("at") + 2, F.size("words")), lambda w: F.struct(F.xxhash64(F.col("one")["word"], w["word"]).alias("key"), w["pos"].alias("pos"), (w["pos"] <= F.col("short_end")).alias("short")))
    alone = F.when(1 / n > over, F.array(F.struct(F.col("one")["word"].alias("key"), (n + 1).alias("pos"), (1 / (2 * n - 1) > over).alias("short")))).otherwise(F.array())
    return each.select("side", "class_id", "n", F.explode(F.concat(two, alone)).alias("k")).select("side", "class_id", "n", "k.*")


def _may_be_similar(a: DataFrame, b: DataFrame, over: float, tie: str) -> DataFrame:
    """a, b: sets of a (class_id a, n na, pos pa) that are keyed as the smaller one, with the sets of b that they meet; tie: which of two of one size are wanted."""
    # nothing before the key's first word is shared in a pair's first key, nothing between its two; one word alone has its place behind the last
    most = F.greatest(F.lit(1), F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 2)
    fits = ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & F.expr(tie))) & (F.col("na") / F.col("nb") > over) & (most / (F.col("na") + F.col("nb") - most) > over)
    return a.join(b.hint("merge"), "key").where(fits).select("a", "b").distinct()


def _sides(keyed: DataFrame, side: int = 0) -> tuple[DataFrame, DataFrame]:
    """The keys of a side as those of smaller sets and of larger ones."""
    mine = keyed.where(F.col("side") == side)
    return mine.where("short").selectExpr("key", "class_id a", "n na", "pos pa"), mine.selectExpr("key", "class_id b", "n nb", "pos pb")


def similar_classes(classes: DataFrame, over: float) -> DataFrame:
    """a, b, score for pairs of different classes with a Jaccard similarity over `over`, a < b. Only sets that share two of their rarest words are compared (see `_keyed`)."""
    small, large = _sides(_keyed(classes.select("class_id", "tokens", F.lit(0).alias("side")), over, 1))
    pairs = _may_be_similar(small, large, over, "a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    sets = classes.select("class_id", "tokens")
    out = pairs.join(sets.selectExpr("class_id a", "tokens ta").hint("merge"), "a").join(sets.selectExpr("class_id b", "tokens tb").hint("merge"), "b")
    return out.select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("score")).where(F.col("score") > over)


def similar_between(left: DataFrame, right: DataFrame, over: float) -> DataFrame:
    """a, b, score for classes (class_id, tokens) of left and right with a Jaccard similarity over `over`; two without words are equal."""
    both = left.select("class_id", "tokens", F.lit(0).alias("side")).unionByName(right.select("class_id", "tokens", F.lit(1).alias("side")))
    keyed = _keyed(both, over, 2)
    (small, large), (other_small, other_large) = _sides(keyed), _sides(keyed, 1)
    pairs = _may_be_similar(small, other_large, over, "true").union(_may_be_similar(other_small, large, over, "false").select("b", "a"))
    pairs = pairs.join(left.selectExpr("class_id a", "tokens ta").hint("merge"), "a").join(right.selectExpr("class_id b", "tokens tb").hint("merge"), "b")
    empty = left.where(F.size("tokens") == 0).selectExpr("class_id a", "tokens").join(right.where(F.size("tokens") == 0).selectExpr("class_id b", "tokens").hint("merge"), "tokens").select("a", "b", F.lit(1.0).alias("score"))
    return pairs.select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("score")).where(F.col("score") > over).union(empty)


def first_similar(items: DataFrame, over: float = 0.4, id_col: str = "rowid", text_col: str = "title") -> DataFrame:
    """id, match: the earliest row before each row whose title is similar; a row without words is like any other without."""
    classes = title_classes(items, id_col, text_col)
    pairs = similar_classes(classes, over)
    links = pairs.select("a", "b").union(pairs.select("b", "a")).union(classes.select("class_id", "class_id")).toDF("own", "other")
    earliest = links.join(classes.selectExpr("class_id other", "first").hint("merge"), "other").groupBy("own").agg(F.min("first").alias("match"))
    rows = items.select(F.col(id_col).alias("id"), F.array_sort(tokens(F.col(text_col))).alias("tokens")).join(classes.selectExpr("tokens", "class_id own").hint("merge"), "tokens")
    return rows.join(earliest.hint("merge"), "own").where("match < id").select("id", "match")


def top_cosine(queries: DataFrame, vectors: DataFrame, k: int, block: int = 16_384, earlier: bool = False, over: float | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: each query's k most similar of all vectors (`earlier`: of those with smaller ids), itself left out, ties to the smaller id. over: only pairs that score more are wanted.

    queries and vectors: vec_id, embedding. The stated query set meets every vector, both dealt by hash into blocks of a bounded size, as they are stored; vectors without length, and null or
    non-finite ones, take no part. In a block a product in single precision names what may be among the best, with room for its error; these get their scores in double precision.
    """
    x = F.col("embedding")
    sound = F.exists(x, lambda e: e != 0) & F.forall(x, lambda e: ~F.isnan(e) & (F.abs(e) < float("inf")))

    def taken(frame: DataFrame) -> DataFrame:
        single = frame.schema["embedding"].dataType.simpleString() == "array<float>"
        return frame.where(sound & F.col("vec_id").isNotNull()).select("vec_id", (x if single else x.cast("array<double>")).alias("v"))

    asked, rows = taken(queries), taken(vectors)
    n_asked, n_rows = asked.count(), rows.count()

    def in_order(products: np.ndarray) -> np.ndarray:
        """Sums of rows, one component after the other, as SQL adds them: equal vectors have equal sums, wherever they stand."""
        return np.add.accumulate(products, axis=1)[:, -1]

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        own, width = right["vec_id"].to_numpy(), right["v"].map(len)
        for n, some in left.groupby(left["v"].map(len)):  # vectors of one dimension are compared
            fit = (width == n).to_numpy()
            if not fit.any():
                continue
            q, v, mine = np.stack(some["v"].to_numpy()).astype(float), np.stack(right["v"].to_numpy()[fit]).astype(float), own[fit]
            q2, v2, ids = in_order(q * q), in_order(v * v), some["vec_id"].to_numpy()
            q1, v1 = ((m / np.sqrt(m2)[:, None]).astype(np.float32) for m, m2 in ((q, q2), (v, v2)))
            room = (n + 8) * 2.0**-22  # twice the most that single precision is off
            for start in range(0, len(ids), 256):
                part = slice(start, start + 256)
                rough = q1[part] @ v1.T
                rough[ids[part, None] <= mine[None, :] if earlier else ids[part, None] == mine[None, :]] = -np.inf
                least = -2.0 if over is None else over - room
                for i in np.flatnonzero(rough.max(1) > least):
                    at = np.flatnonzero(rough[i] > least)
                    if len(at) > k:
                        at = at[rough[i][at] >= np.partition(rough[i][at], -k)[-k] - room]
                    score = np.clip(in_order(v[at] * q[start + i]) / np.sqrt(q2[start + i] * v2[at]), -1.0, 1.0)
                    if over is not None:
                        at, score = at[score > over], score[score > over]
                    best = np.lexsort((mine[at], -score))[:k]
                    out.append(pd.DataFrame({"query_id": ids[start + i], "vec_id": mine[at[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})

    def dealt(frame: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        # of one type on both sides: equal numbers of two types lie in two partitions
        return frame.select("*", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    # each block of queries meets each block of vectors in one task
    q_blocks, v_blocks = max(1, -(-n_asked // block)), max(1, -(-n_rows // block))
    left, right = dealt(asked, "qb", q_blocks, "vb", v_blocks), dealt(rows, "vb", v_blocks, "qb", q_blocks)
    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(scan, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def knn_then_filter(queries: DataFrame, vectors: DataFrame, items: DataFrame, k: int, since: float) -> DataFrame:
    """The k nearest of all vectors first, then only new rows since a time, by similarity."""
    near = top_cosine(queries, vectors, k)
    fit = items.where((F.col("status") == "new") & (F.col("created_at") >= since)).select(F.col("rowid").alias("vec_id"))
    return near.join(fit, "vec_id").select("query_id", "vec_id", "score", "rank")


def fused_ranks(knn: DataFrame, fts: DataFrame, k: int, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """id, score, cosine by reciprocal ranks: knn (id, cosine) and fts (id, relevance); ranks from one, no constant."""
    a = knn.select("id", "cosine", F.row_number().over(Window.orderBy(F.desc("cosine"), "id")).alias("ra"))  # over the few candidates of one search
    b = fts.select("id", F.row_number().over(Window.orderBy(F.desc("relevance"), "id")).alias("rb"))
    score = F.coalesce(weights[0] / F.col("ra"), F.lit(0.0)) + F.coalesce(weights[1] / F.col("rb"), F.lit(0.0))
    out = a.join(b, "id", "full_outer").select("id", score.alias("score"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
    return out.orderBy(F.desc("score"), "id").limit(k)


def hybrid(knn: DataFrame, fts: DataFrame, k: int) -> DataFrame:
    """The fused ranks of the 2k best by cosine and the k best by relevance: only those reach one task."""
    return fused_ranks(knn.orderBy(F.desc("cosine"), "id").limit(2 * k), fts.orderBy(F.desc("relevance"), "id").limit(k), k)
