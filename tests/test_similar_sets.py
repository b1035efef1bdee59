import random

import pytest

from tidewire.operators import similarity

FORM = "class_id long, tokens array<string>"


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("over", [0.1, 1 / 3, 0.4, 0.75])
def test_pairs_match_brute_force(spark, over):
    """Sets of no word up to nine, of rare words and common ones, within one table and between two."""
    rng = random.Random(int(100 * over))
    words = [f"w{i}" for i in range(30)]
    drawn = {tuple(sorted({rng.choice(words[: rng.choice((4, 30))]) for _ in range(rng.randint(0, 9))})) for _ in range(160)}
    sets = [(i, list(t)) for i, t in enumerate(sorted(drawn))]
    got = {(r.a, r.b) for r in similarity.similar_classes(spark.createDataFrame(sets, FORM), over).collect()}
    assert got == {(i, j) for i, a in sets for j, b in sets if i < j and like(set(a), set(b)) > over}
    rng.shuffle(sets)
    left, right = sets[:90], sets[60:]
    both = similarity.similar_between(spark.createDataFrame(left, FORM), spark.createDataFrame(right, FORM), over).collect()
    assert {(r.a, r.b) for r in both} == {(i, j) for i, a in left for j, b in right if like(set(a), set(b)) > over}


def test_sets_that_share_one_word_are_not_compared(spark, monkeypatch):
    """Points of a plane as sets of the lines through them: two share one line at most, however many lie on it."""
    lines = lambda x, y: [f"{s}/{(y - s * x) % 13}" for s in range(6)]
    sets = [(13 * x + y, sorted(lines(x, y))) for x in range(13) for y in range(13)]
    sets.append((999, sets[0][1][:4] + ["x", "y"]))
    monkeypatch.setattr(similarity, "jaccard", lambda a, b: similarity.F.lit(1.0))  # each pair that is compared counts
    assert [(r.a, r.b) for r in similarity.similar_classes(spark.createDataFrame(sets, FORM), 0.4).collect()] == [(0, 999)]
