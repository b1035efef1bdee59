import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire.llm import ngram_join


def plain_sets(texts):
    out = {}
    for key, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[key] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    return out


def plain_components(ids, sets):
    """ids: key -> doc id; every pair is compared."""
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    keys = [k for k in sets if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    least = {}
    for k in sets:
        least[top(k)] = min(least.get(top(k), ids[k]), ids[k])
    return {k: least[top(k)] for k in sets}


def families(seed, groups=14):
    """Chains and stars of near copies at many similarities, shared passages, short texts and exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 8, 30, 90, 200]))]
        if g % 3 == 0:
            base = passage + base
        for _ in range(rng.randint(1, 9)):
            w = list(base if rng.random() < 0.6 else texts[-1].split() if texts else base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        texts.append(" ".join(base).upper())
    texts += ["", "  ", "one two", "ONE two", "one two three", *["a b c d e"] * 3]
    rng.shuffle(texts)
    return dict(enumerate(texts, 100))


def compare(rows, texts):
    sets = plain_sets(texts)
    want = plain_components({k: k for k in texts}, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(texts)
    assert got == {k: (len(sets[k]), want[k]) for k in texts}


def test_query_matches_brute_force(spark, sf, texts):
    compare(ngram_join.op4_ngram_join(spark, sf).collect(), texts)


@pytest.mark.parametrize("seed", range(3))
def test_families_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", 3)  # the reordering counts on small tables too
    texts = families(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    compare(ngram_join.near_duplicates(docs).collect(), texts)


def test_star_does_not_pair_a_group(spark):
    """A large group of near copies is compared with centres, not each with each."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, links = ngram_join.linked_sets(docs)
    assert links.count() < 150 * 12
    assert {r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {0}


def test_odd_rows(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in ngram_join.near_duplicates(odd_docs).collect()}
    assert got[1].n_shingles == 0 and got[1].component_id == 1 and got[7].component_id == 7
    assert got[6].component_id == 5 and got[3].n_shingles == 1
    assert ngram_join.near_duplicates(odd_docs).count() == odd_docs.count()
    assert ngram_join.near_duplicates(no_docs).count() == 0
    kept = ngram_join.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert ngram_join.representatives(no_docs).count() == 0


def test_components_of_long_chains(spark):
    edges = spark.range(0, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in ngram_join.components(edges).collect()} == {0}
