"""The cumulative link's likelihood and gradients against plain sums and finite differences, and a fit that is the same each time."""

import numpy as np
import pytest

from tidewire.llm import quality


def made(seed, grades, n=40, size=30):
    rng = np.random.default_rng(seed)
    rows = [(np.sort(rng.choice(size, rng.integers(1, 6), replace=False)).astype(np.int32), rng.normal(size=6)[:0], int(rng.integers(grades))) for _ in range(n)]
    rows = [(i, rng.normal(size=len(i)), g) for i, _, g in rows]
    model = quality.CumulativeLink(grades, size)
    model.weights, model.low, model.steps = rng.normal(size=size), -0.3, rng.normal(size=grades - 2) * 0.3
    return rows, model


def plain(model, rows):
    total = 0.0
    for index, value, grade in rows:
        s = sum(model.weights[i] * v for i, v in zip(index, value, strict=True))
        up_to = [0.0, *(1 / (1 + np.exp(-(t - s))) for t in model.thresholds), 1.0]
        total += np.log(max(up_to[grade + 1] - up_to[grade], 1e-6))
    return total


@pytest.mark.parametrize("grades", [2, 3, 5])
def test_likelihood_and_gradients(grades):
    rows, model = made(grades, grades)
    every = np.arange(len(rows))
    value, by_weight, by_cut = model.gradients(quality.Rows(rows), every)
    assert value == pytest.approx(plain(model, rows))
    h = 1e-5
    for k in range(len(model.weights)):
        ends = []
        for d in (h, -h):
            model.weights[k] += d
            ends.append(plain(model, rows))
            model.weights[k] -= d
        assert by_weight[k] == pytest.approx((ends[0] - ends[1]) / (2 * h), abs=1e-4)
    cut = np.append(model.low, model.steps)
    for k in range(len(cut)):
        ends = []
        for d in (h, -h):
            moved = cut.copy()
            moved[k] += d
            model.low, model.steps = moved[0], moved[1:]
            ends.append(plain(model, rows))
        model.low, model.steps = cut[0], cut[1:]
        assert by_cut[k] == pytest.approx((ends[0] - ends[1]) / (2 * h), abs=1e-4)
    some = np.array([3, 17, 5])
    assert model.gradients(quality.Rows(rows), some)[0] == pytest.approx(plain(model, [rows[k] for k in some]))


def test_fit_raises_the_likelihood():
    rows, _ = made(8, 3, 300)
    model = quality.CumulativeLink(3, 30)
    before = plain(quality.CumulativeLink(3, 30), rows)
    assert plain(model.fit(quality.Rows(rows)), rows) > before + 20
    assert list(model.thresholds) == sorted(model.thresholds)


def test_query_scores_are_the_models(spark, sf, texts):
    """Each text scored by the plain formula under the fitted model; the fit is the same each time, with ids and rows repeated."""
    labels = quality.graded(spark.read.parquet(f"{sf}/labels.parquet"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit_quality(docs, labels)
    again = quality.fit_quality(docs.union(docs).repartition(9), labels.union(labels))
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.thresholds, again.thresholds)
    for r in quality.op7_quality(spark, sf).collect():
        index, value = quality.features(texts[r.doc_id])
        s = sum(model.weights[i] * v for i, v in zip(index, value, strict=True))
        above = [1 - 1 / (1 + np.exp(-(t - s))) for t in model.thresholds]
        assert r.expected_grade == pytest.approx(sum(above)) and r.tail_prob == pytest.approx(above[0]) and r.selected == (r.tail_prob >= 0.5)
