"""Keeping the first for a while, against a sequential scan."""

import random

import pytest

from tidewire.operators.anchors import first_for_a_while
from tidewire.operators.dedup import rolling_titles, run_pending

FORM = "key string, at long, id string"


def scan(rows, span, fixed=()):
    kept, match = {}, {}
    for k, at, i in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        by = [f for f in fixed if f[0] == k and f[1] is not None and at - span <= f[1] <= at]
        last = kept.get(k)
        if by:
            match[i] = max(by, key=lambda f: (f[1], f[2]))[2]
        elif last and at - last[0] <= span:
            match[i] = last[1]
        else:
            kept[k] = (at, i)
            match[i] = None
    return match | {r[2]: None for r in rows if r[0] is None or r[1] is None}


def got(spark, rows, span, fixed=None):
    out = first_for_a_while(spark.createDataFrame(rows, FORM), span, None if fixed is None else spark.createDataFrame(fixed, FORM)).collect()
    assert len(out) == len(rows)
    return {r.id: r.match for r in out}


@pytest.mark.parametrize("seed", range(3))
def test_as_a_sequential_scan(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", "c", f"u{i}", None]), None if rng.random() < 0.02 else rng.randint(-300, 300), f"i{i:04}") for i in range(400)]
    span = rng.choice([0, 1, 7, 20])
    assert got(spark, rows, span) == scan(rows, span)
    fixed = [(rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randint(-300, 300)]), f"f{i}") for i in range(30)]
    assert got(spark, rows, span, fixed) == scan(rows, span, fixed)


def test_chains_and_gaps(spark):
    chain = [("x", 10 * i, f"c{i:04}") for i in range(900)]
    for span in (9, 10, 11, 35, 100_000):
        assert got(spark, chain, span) == scan(chain, span)
    gaps = [("x", at, f"g{at}") for at in (0, 5, 6, 7, 500, 505, 507, 511, 90_000, 10**15)]
    assert got(spark, gaps, 6) == scan(gaps, 6)
    assert got(spark, [], 5) == {} and got(spark, [("x", 1, "a"), ("x", 1, "b")], 0) == {"a": None, "b": "a"}


def test_a_key_with_a_third_of_all_rows(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", (i * 7919) % 5000, f"i{i:06}") for i in range(12_000)]
    assert got(spark, rows, 72) == scan(rows, 72)


def test_titles_return_after_the_window(spark):
    hour = lambda h: f"2024-01-{1 + h // 24:02}T{h % 24:02}:00:00Z"
    rows = [(f"h{n}", t, hour(h), s, "auto", d) for n, (t, h, s, d) in enumerate([
        ("One", 0, "pending", ""), ("breaking: one", 50, "pending", ""), ("ONE", 73, "pending", ""), ("one", 140, "pending", ""),
        ("two", 0, "ai_generated", "new"), ("Two", 72, "pending", ""), ("two", 73, "pending", ""), ("three", 0, "irrelevant", ""), ("three", 1, "pending", None),
    ])]
    articles = spark.createDataFrame(rows, "article_hash string, title string, collected_at string, summary_status string, category string, dedup_decision string")
    rolling = {r.article_hash: r.dedup_match for r in rolling_titles(articles).collect()}
    assert rolling == {"h0": None, "h1": "h0", "h2": None, "h3": "h2", "h4": None, "h5": "h4", "h6": None, "h7": None, "h8": "h7"}
    run = {r.article_hash: tuple(r)[1:] for r in run_pending(articles).collect()}
    dup = lambda m: ("duplicate", 1, "same_title", m, None)
    new = ("new", None, None, None, None)
    assert run == {"h0": new, "h1": dup("h0"), "h2": new, "h3": dup("h2"), "h5": dup("h4"), "h6": new, "h8": new}
