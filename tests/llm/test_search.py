"""Nearest neighbours, benchmark leaks and URL lists."""

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.llm import ann, decontamination, url_filters


def plain_nearest(rows, k=20):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    out = {}
    for i, x in rows:
        if i % 20 == 0:
            s = v @ np.array(x, float)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_neighbours_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = plain_nearest(rows), {}
    for r in ann.op6_ann(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    assert all([x[0] for x in v] == list(range(1, 21)) for v in got.values())
    assert np.mean([len({x[1] for x in got[q]} & {x[0] for x in want[q]}) / 20 for q in want]) >= 0.9
    vectors = dict(rows)
    for q, found in got.items():
        for _, i, s in found:
            assert abs(s - np.dot(np.array(vectors[q], float), np.array(vectors[i], float))) < 1e-12


def test_multi_index_finds_every_code_within_the_radius():
    x = np.random.default_rng(0).normal(size=(900, 16))
    coder = ann.Coder(x[:300], k=5, bits=32, target=0.6)
    index = ann.MultiIndex(coder, x)
    for radius in (0, 2, 5, 9):
        coder.radius = radius
        spare = radius - index.codes.shape[1] + 1
        coder.shares = [max(-1, spare // 4 + (j < spare % 4)) for j in range(4)]
        for code in index.codes[:40]:
            gaps = np.unpackbits(index.codes ^ code, axis=1).sum(1)
            assert index.within(code).tolist() == np.flatnonzero(gaps <= radius).tolist()


def test_neighbour_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 120)]
    rows += [(i, [1.0] * 8) for i in range(200, 260)]  # equal vectors
    odd = [(300, None), (320, [0.0] * 8), (340, [float("nan")] + [1.0] * 7), (360, [None] + [1.0] * 7), (380, [float("inf")] * 8), (400, [1.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    want = plain_nearest(rows)
    assert set(got) == set(want)
    assert got[200] == [*range(201, 221)] and got[240] == [*range(200, 220)]
    assert np.mean([len(set(got[q]) & {x[0] for x in want[q]}) / 20 for q in want]) >= 0.9
    assert ann.nearest(frame.where("vec_id > 290 and vec_id < 390"), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(20, [1.0, 2.0]), (21, [2.0, 1.0]), (22, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(1, 21), (2, 22)]


@pytest.mark.parametrize("n", [10, 15, 20, 21])
def test_small_tables_lose_no_pair(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(0, 20 * n, 20)]
    frame, got = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in found] for q, found in plain_nearest(rows).items()}


def test_isolated_queries_get_their_nearest(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 32)) * 5
    rows = [(i + 1, (centres[i % 12] + rng.normal(size=32) * 0.05).tolist()) for i in range(1999) if (i + 1) % 20]
    rows += [(20 * i, (rng.normal(size=32) * 5).tolist()) for i in range(1, 9)]
    frame, got = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = plain_nearest(rows)
    assert {q: len(v) for q, v in got.items()} == dict.fromkeys(want, 20)
    assert all(len(set(got[q]) & {i for i, _ in want[q]}) >= 18 for q in want)


def test_repeated_ids(spark):
    """Equal rows are one candidate and a query each; an id's other vectors are candidates, but not its own."""
    rng = np.random.default_rng(9)
    one, other = rng.normal(size=8).tolist(), rng.normal(size=8).tolist()
    rows = [(20, one)] * 30 + [(i, rng.normal(size=8).tolist()) for i in range(101, 137)] + [(41, other), (41, one)]
    frame, got = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {}
    for r in ann.nearest(frame, F.col("vec_id") == 20).collect():
        got.setdefault(r.rank, []).append((r.query_id, r.vec_id))
    distinct = [(20, one), *rows[30:]]
    score = lambda x: -float(np.dot(x[1], one))
    want = [i for i, _ in sorted((x for x in distinct if x[0] != 20), key=lambda x: (score(x), x[0]))][:20]
    assert {r: set(x) for r, x in got.items()} == {r: {(20, i)} for r, i in enumerate(want, 1)}
    assert all(len(x) == 30 for x in got.values())


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=12))
def test_edit_distance(a, b):
    n = len(b)
    window = (a * n)[:n]
    assert decontamination.edit_distances(np.array([window], np.uint64), np.array(b, np.uint64))[0] == edit(window, b)


def plain_leaks(text, items):
    """Every window of every item's size."""
    words, out = decontamination.words_of(text).tolist(), {}
    for i, t in items.items():
        w = decontamination.words_of(t).tolist()
        n = len(w)
        spans = [words[s : s + n] for s in range(max(1, len(words) - n + 1))] if words else []
        least = min((edit(x, w) for x in spans), default=n) if n else 1
        if n and least <= decontamination.allowed(n):
            out[i] = least
    return out


def test_recall_at_the_tolerance():
    rng = np.random.default_rng(2)
    items = {i: " ".join(f"w{x}" for x in rng.integers(0, 3000, n)) for i, n in enumerate([12, 15, 20, 25, 30, 40, 50, 55] * 6)}
    block, found, total = decontamination.Items(list(items.items())), 0, 0
    for i, t in items.items():
        w = t.split()
        for _ in range(4):
            v = list(w)
            for p in rng.choice(len(v), decontamination.allowed(len(v)), replace=False):
                v[p] = f"y{rng.integers(9999)}"
            doc = " ".join([f"z{x}" for x in rng.integers(0, 900, 40)] + v + [f"z{x}" for x in rng.integers(0, 900, 40)])
            found += i in {h[0] for h in block.search([doc])[0]}
            total += 1
    assert found / total >= 0.98


@pytest.mark.parametrize("edits", [5, 6, 8])
@pytest.mark.parametrize("kind", ["inserted", "dropped"])
def test_inserted_and_dropped_words(kind, edits):
    rng = np.random.default_rng(edits)
    item = [f"w{x}" for x in rng.choice(3000, 40, replace=False)]
    block = decontamination.Items([(1, " ".join(item))])
    for _ in range(20):
        v = list(item)
        for p in sorted(rng.choice(np.arange(1, 39), edits, replace=False), reverse=True):
            v[p:p + (kind == "dropped")] = ["extra"] * (kind == "inserted")
        doc = " ".join([f"z{x}" for x in range(40)] + v + [f"z{x}" for x in range(40)])
        (item_id, _, fewest, n), = block.search([doc])[0]
        assert (item_id, n) == (1, 40) and fewest <= edits


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=14), st.lists(st.integers(1, 4), min_size=1, max_size=8))
def test_best_stretch(words, item):
    edits, start = decontamination.best_stretch(np.array(words, np.uint64), np.array(item, np.uint64))
    least = {(a, b): edit(words[a:b], item) for a in range(len(words) + 1) for b in range(a, len(words) + 1)}
    assert edits == min(least.values()) and any(a == start and d == edits for (a, _), d in least.items())


def test_leaks_match_brute_force(spark, sf, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.op3_decontamination(spark, sf).collect()}
    leaky = sorted({d for d, _ in got}, key=lambda d: len(texts[d]))[:3]
    checked = {*leaky, *[k for k, t in texts.items() if len(t or "") < 500][:8]}
    want = {(k, i): e for k in checked for i, e in plain_leaks(texts[k], items).items()}
    assert {k: v for k, v in got.items() if k[0] in checked} == want
    assert got


def test_leaks_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the same words stand here again and again"), (2, None), (3, ""), (4, "one"), (5, "mail a.b@c.example.org token"), (1, "The same words, stand here AGAIN and again!")], "item_id long, text string")
    rows = sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(odd_docs, items).collect())
    assert rows == [(3, 4), (4, 5), (5, 1), (5, 1), (5, 1), (5, 1), (6, 1), (6, 1)]
    assert decontamination.find_leaks(no_docs, items).count() == 0
    assert decontamination.find_leaks(odd_docs, items.limit(0)).count() == 0
    kept = decontamination.without_leaks(odd_docs, items)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 7, 8]


def test_blocks_of_items(spark, sf, monkeypatch):
    whole = decontamination.op3_decontamination(spark, sf).count()
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 7)
    assert decontamination.op3_decontamination(spark, sf).count() == whole


def test_url_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    want = con.execute(url_filters.SQL).fetchall()
    got = [tuple(r) for r in url_filters.op8_url_filters(spark, sf).collect()]
    assert sorted(got) == sorted(want) and any(r[-1] for r in got) and any(not r[-1] for r in got)


def test_url_intervals_and_odd_rows(spark):
    entries = spark.createDataFrame([("l", "Bad.example", "add", 10, "x"), ("l", "bad.example", "remove", 20, "x"), ("m", "www.bad.example", "add", 15, "y"), ("l", "bad.example", "add", 30, "z"), ("l", "tie.example", "add", 5, "t"), ("l", "tie.example", "remove", 5, "t")], "list string, pattern string, action string, effective long, category string")
    rows = [("http://www.bad.example/a", t) for t in (9, 10, 15, 19, 20, 30, None)] + [("https://u:p@BAD.example.:80/", 12), ("http://notbad.example", 12), (None, 12), ("no url", 12), ("http://tie.example", 9)]
    captures = spark.createDataFrame([(u, t, "h") for u, t in rows], "url string, fetched_at long, host string")
    out = url_filters.judge(captures, entries)
    got = {(r.url, r.fetched_at): (r.n_entries, r.categories) for r in out.collect()}
    www = "http://www.bad.example/a"
    assert [got[www, t] for t in (9, 10, 15, 19, 20, 30, None)] == [(0, ""), (1, "x"), (2, "x,y"), (2, "x,y"), (1, "y"), (2, "y,z"), (0, "")]
    assert got["https://u:p@BAD.example.:80/", 12] == (1, "x") and got["http://notbad.example", 12] == (0, "")
    assert got[None, 12] == (0, "") and got["no url", 12] == (0, "") and got["http://tie.example", 9] == (0, "")
    assert url_filters.judge(captures, entries.limit(0)).where("blocked").count() == 0
    assert url_filters.judge(captures.limit(0), entries).count() == 0
    assert out.count() == len(rows)


@pytest.mark.parametrize("most", [url_filters.BROADCAST_SPANS, 0])
def test_url_names_that_clash(spark, monkeypatch, most):
    """Result columns win over columns of their name in any case; others go through; by broadcast or by a salted shuffle."""
    monkeypatch.setattr(url_filters, "BROADCAST_SPANS", most)
    entries = spark.createDataFrame([("l", "bad.example", "add", 10, "x")], "list string, pattern string, action string, effective long, category string")
    captures = spark.createDataFrame([("http://a.bad.example/", 12, "h", "s", 7)] * 40, "url string, fetched_at long, Host string, spans string, SALT long")
    rows = url_filters.judge(captures, entries).collect()
    assert [tuple(r) for r in rows] == [("http://a.bad.example/", 12, "s", 7, "a.bad.example", 1, "x", True)] * 40


@pytest.mark.parametrize("url, host", [("http://A.b/c", "a.b"), ("ftp://x.y:21", "x.y"), ("//a.b", None), ("", None)])
def test_host(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(url_filters.host_of(F.col("u"))).first()[0] == host


def test_long_item_beside_short_ones():
    rng = np.random.default_rng(3)
    item = [f"w{x}" for x in rng.integers(0, 5000, 6000)]
    block = decontamination.Items([(1, " ".join(item)), (2, "some short item of nine words stands here too")])
    copy = [w for i, w in enumerate(item) if i % 12]  # a twelfth dropped
    (found,) = block.search([" ".join([f"z{x}" for x in range(500)] + copy + ["end"] * 500)])
    assert [(h[0], h[3]) for h in found] == [(1, 6000)] and found[0][2] <= 500
    assert block.search(["end " * 20 + "some short item of ten words stands here too"])[0][0][0] == 2
