"""BM25 with lists left out, against plain scores."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.operators import text_search


def plain(docs, queries, k):
    bags = {i: Counter(w for w in re.findall(r"\w+", (t or "").lower()) if len(w) > 1) for i, t in docs}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / max(len(bags), 1)
    df = Counter(w for b in bags.values() for w in b)
    out = {}
    for q, terms in queries:
        scores = {}
        for i, b in bags.items():
            hits = [w for w in set(terms) if w in b]
            if hits:
                scores[i] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in hits), 9)
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out[q, rank] = (i, pytest.approx(s, abs=2e-9))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_top_k_is_that_of_plain_scores(spark, seed):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(1, 30)) + [rare[int(300 * rng.random() ** 2)] for _ in range(rng.randint(0, 25))])) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(15)] + [(2000, None), (2001, ""), (2002, "x y")]
    queries = [(q, [*rng.sample(common, rng.randint(0, 3)), *rng.sample(rare, rng.randint(0, 5)), "never"]) for q in range(25)] + [(90, ["the"]), (91, []), (92, docs[7][1].split())]
    held = text_search.index(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = text_search.search(held, spark.createDataFrame(queries, "query_id long, terms array<string>"), 10).collect()
    held.drop()
    assert {(r.query_id, r.rank): (r.id, r.score) for r in rows} == plain(docs, queries, 10)


def test_common_lists_name_no_candidates(spark):
    """A word of every row beside a rare one: only the rare one's rows are scored."""
    docs = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.expr("concat('common word ', id, case when id % 200 = 0 then ' rare rare' else '' end)").alias("text"))
    held = text_search.index(docs)
    query = spark.createDataFrame([(1, ["common", "rare"])], "query_id long, terms array<string>")
    out = text_search.search(held, query, 10)
    assert [r.id for r in out.orderBy("rank").collect()] == [200 * i for i in range(10)]
    most = {r.term: r.most for r in held.terms.rows.where("term in ('common', 'rare')").collect()}
    assert most["common"] < 0.01 < most["rare"]


def test_an_empty_table(spark):
    held = text_search.index(spark.createDataFrame([], "doc_id long, text string"))
    assert text_search.search(held, spark.createDataFrame([(1, ["a"])], "query_id long, terms array<string>")).count() == 0


def test_blocks_of_texts_and_queries(spark, monkeypatch):
    """Blocks whose partitions are not merged: words that all share bring no pairs of queries and texts into a shuffle."""
    monkeypatch.setattr(text_search, "BLOCK_POSTINGS", 500)
    monkeypatch.setattr(text_search, "BLOCK_QUERIES", 7)
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices([f"w{j}" for j in range(12)], k=rng.randint(0, 15)))) for i in range(400)]
    queries = [(q, rng.sample([f"w{j}" for j in range(12)], 5)) for q in range(30)]
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        rows = text_search.search(text_search.index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(queries, "query_id long, terms array<string>"), 10).collect()
    finally:
        spark.conf.unset(name)
    assert {(r.query_id, r.rank): (r.id, r.score) for r in rows} == plain(docs, queries, 10)
