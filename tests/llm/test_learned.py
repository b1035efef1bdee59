"""Toxicity, quality and the boosted trees: held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from tidewire.llm import boosting, quality, toxicity


def marked(spark, seed=1, n=500):
    """Texts in an invented language; the toxic ones hold inflected stems that clean ones do not."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "lo", "ti", "ne", "su", "ra", "ke"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 60))]
        toxic = int(rng.random() < 0.3)
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["zarg", "vexom"]) + rng.choice(["a", "ite", "um", "or", "ens"]))
        docs.append((i, " ".join(w) + "."))
        labels.append((i, int(i % 3 > 0), toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_stems(spark):
    docs, labels = marked(spark)
    grammar = toxicity.fit_grammar(docs, labels)
    assert any("zarg".startswith(b) for b in grammar.lexicon.beginnings)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score_toxicity(docs, grammar).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in rows]) > 0.97


def test_toxicity_query(spark, sf, texts):
    rows = toxicity.op2_toxicity(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    insults = ("idiot", "moron", "stupid", "pathetic", "worthless")
    for r in rows:
        if sum(w in (texts[r.doc_id] or "").lower().split() for w in insults) >= 2:
            assert r.predicted == 1


def test_grammar_scores_clauses():
    g = toxicity.Grammar(toxicity.Lexicon({}, {}))
    assert g.score("You idiot, you worthless scum.") > 0.5 > g.score("He is not an idiot.")
    assert g.score("You moron. You loser.") > g.score("They reported that someone called him a moron. The report said loser.")
    assert g.score("I will kill you. We will hurt them.") > g.score("We kill time. They never hurt you.")
    assert g.score("") < 0.5 and g.score(None) < 0.5
    kinds = [k for k, *_ in g.lexicon.matches("not an idiot. she said idiot. you idiot. idiot")[1]]
    assert kinds == ["negated", "reported", "targeted", "plain"]


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 1), (3, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    grammar = toxicity.fit_grammar(odd_docs, labels)
    assert toxicity.score_toxicity(odd_docs, grammar).count() == odd_docs.count()
    grammar = toxicity.fit_grammar(no_docs, labels.limit(0))
    assert toxicity.score_toxicity(no_docs, grammar).count() == 0
    kept = toxicity.without_toxic(odd_docs, grammar)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    grades = quality.graded(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    train, test = grades.where("doc_id % 3 > 0"), {r.doc_id: r.grade for r in grades.where("doc_id % 3 = 0").collect()}
    model = quality.fit_quality(docs, train)
    assert (np.diff(model.thresholds) > 0).all()
    got = [(r.tail_prob, test[r.doc_id] > 0) for r in quality.score_quality(docs, model).collect() if r.doc_id in test]
    low, high = [p for p, good in got if not good], [p for p, good in got if good]
    assert np.mean([a < b for a in low for b in high]) > 0.9


def test_quality_odd_rows(spark, odd_docs, no_docs, sf):
    ratings = spark.createDataFrame([(1, 0), (2, 1), (4, 2), (5, 9), (None, 1)], "doc_id long, grade int")
    model = quality.fit_quality(odd_docs, ratings)
    rows = quality.score_quality(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_prob <= 1 for r in rows)
    assert quality.score_quality(no_docs, quality.fit_quality(no_docs, ratings.limit(0))).count() == 0
    assert quality.op7_quality(spark, sf).columns == ["doc_id", "expected_grade", "tail_prob", "selected"]


@pytest.mark.parametrize("depth", [1, 3])
def test_boosted_trees(depth):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float) if depth > 1 else (x[:, 2] > 0.1).astype(float)
    trees = boosting.BoostedTrees(depth=depth).fit(x[:800], y[:800])
    assert np.mean((trees.margin(x[800:]) > 0) == y[800:]) > 0.93
    a, b = boosting.platt(trees.margin(x[800:]), y[800:])
    assert a > 0 and abs(np.mean(1 / (1 + np.exp(-(a * trees.margin(x[800:]) + b)))) - y[800:].mean()) < 0.05


def test_composed_transducer_matches_its_parts():
    """Random clauses against the three transducers side by side."""
    rng = np.random.default_rng(1)
    for _ in range(400):
        tags = rng.integers(0, 6, rng.integers(1, 14)).tolist()
        state, n, r, t, got, want = int(toxicity.TARGET in tags), 0, 0, 0, [], []
        for tag in tags:
            state, kind, weight = toxicity.ARCS[state][tag]
            got.append((kind, weight))
            if tag == toxicity.INSULT:
                want.append(("negated" if n else "reported" if r else "targeted" if toxicity.TARGET in tags else "plain", 1.0))
            else:
                want.append(("threat", 2.0) if tag == toxicity.TARGET and t and not n and not r else (None, 0.0))
            n, r, t = toxicity.NEGATION_ARCS[n, tag], toxicity.REPORT_ARCS[r, tag], toxicity.THREAT_ARCS[t, tag]
        assert got == want


def test_held_out_accuracy(spark):
    """On the driver's labels, of rows that did not teach. (Some toxic rows there hold no word that tells.)"""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels.where(toxicity.remainder("doc_id") == 0).select("doc_id", "toxic").where("toxic in (0, 1)"), "doc_id")
    scored = toxicity.score_toxicity(held, toxicity.fit_grammar(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id")
    right = [(r.toxic, r.predicted) for r in scored.collect()]
    assert len(right) > 500 and sum(a == b for a, b in right) >= 0.97 * len(right)
    assert sum(b for a, b in right if a) >= 0.8 * sum(a for a, _ in right) and sum(b for a, b in right if not a) <= 0.01 * len(right)


def test_coefficients_minimise_their_loss():
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(500, 7))) * [8, 2, 2, 8, 2, 8, 3]
    y = (x[:, 0] + x[:, 3] + rng.normal(size=500) > 12).astype(float)
    g = toxicity.Grammar(toxicity.Lexicon({}, {}), x, y)
    a = np.hstack([x, np.ones((500, 1))])
    slope = a.T @ (1 / (1 + np.exp(-a @ g.weights)) - y) + toxicity.RIDGE * (g.weights - g.DEFAULT)
    assert abs(slope).max() < 1e-3
