"""The cascade by batches against a scan of one row after the other."""

import datetime
import glob
import math
import random
from pathlib import Path

from pyspark.sql import functions as F

from tidewire.operators.cascade import Decisions
from tidewire.plans import catalog, views

HOUR = 3600.0
FORM = "rowid long, id_hash string, title_hash string, title string, content_path string, embedding array<double>"


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def like(a, b):
    a, b = ({w for w in t.lower().split() if len(w) > 1} for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def scan(batches, hours, k=10, judge=lambda a, b: False):
    """batches: (now, rows). Each row meets the new ones before it, its windows counting from its batch's time."""
    done, out = [], {}
    for now, rows in batches:
        for r in sorted(rows):
            i, ih, th, t, _, v = r
            new = [d for d in done if out[d[0]][0] == "new"]
            back = lambda d, h: d[6] >= now - HOUR * h
            ranked = sorted(((cosine(v, d[5]), -d[0]) for d in done if v and d[5] and any(v) and any(d[5]) and back(d, hours[2])), reverse=True)[:k]
            near = {-b: s for s, b in ranked}
            layer = 0 if any(d[1] == ih for d in new) else 1 if any(d[2] == th and back(d, hours[0]) for d in new) else 2 if any(like(t, d[3]) > 0.4 and back(d, hours[1]) for d in new) else None
            if layer is None:
                scores = {d[0]: near[d[0]] for d in new if d[0] in near}
                layer = 3 if any(s > 0.85 for s in scores.values()) else 4 if any(0.75 < s <= 0.85 and judge(i, b) for b, s in scores.items()) else None
            out[i] = ("new" if layer is None else "dupe", layer)
            done.append((*r, now))
    return out


def made(seed, n=5, size=40):
    rng, rows, start = random.Random(seed), [], 1704067200.0
    words = [f"w{i}" for i in range(40)]
    for b in range(n):
        some = []
        for i in range(size):
            v = None if rng.random() < 0.2 else [rng.gauss(0, 1) for _ in range(3)]
            some.append((b * size + i, f"h{rng.randint(0, 300)}", f"t{rng.randint(0, 250)}", " ".join(rng.sample(words, rng.choice([0, 3, 4, 5, 6, 7]))), f"p{b}/{i}", v))
        rows.append((start + b * 9 * HOUR, some))
    return rows


def test_batches_are_decided_as_one_after_the_other(spark, tmp_path):
    batches, hours = made(1), (30, 10, 20)
    store = Decisions(spark, str(tmp_path / "s"), hours, buckets=4)
    odd = lambda pairs: pairs.where((F.col("a") + F.col("b")) % 2 == 1)
    for now, rows in batches:
        store.feed(spark.createDataFrame(rows, FORM), now, judge=odd)
    want = scan(batches, hours, judge=lambda a, b: (a + b) % 2 == 1)
    got = {r.rowid: (r.status, r.layer) for r in store.items.collect()}
    assert got == want and {layer for _, layer in want.values()} == {None, 0, 1, 2, 3, 4}
    paths = {r[0]: r[4] for _, rows in batches for r in rows}
    assert {r.rowid: r.content_path for r in store.items.collect()} == paths
    assert store.last_rowid() == max(paths)


def test_days_outside_the_windows_are_not_read(spark, tmp_path):
    """Files of old days, and of buckets that hold none of the batch's hashes, are made unreadable."""
    store = Decisions(spark, str(tmp_path / "s"), (72, 24, 72), buckets=16)
    start = 1704067200.0
    row = lambda i, h, t: (i, h, f"t-{t}", f"only{t} words{t}", f"p{i}", None)
    store.feed(spark.createDataFrame([row(i, f"h{i}", i) for i in range(30)], FORM), start)
    store.feed(spark.createDataFrame([row(i, f"h{i}", i) for i in range(30, 60)], FORM), start + 200 * HOUR)
    old = datetime.datetime.fromtimestamp(start, datetime.UTC).date()
    for f in glob.glob(str(tmp_path / "s" / "items" / f"day={old}" / "*.parquet")):
        Path(f).write_bytes(b"no table")
    batch = spark.createDataFrame([row(60, "h3", 3), row(61, "x", 5), row(62, "y", 40), row(63, "z", 63)], FORM)
    touched = {r.bucket for r in store.ids.suspects(batch).collect()}
    assert len(touched) <= 2
    for f in glob.glob(str(tmp_path / "s" / "ids" / "bucket=*" / "*.parquet")):
        if not any(f"/bucket={b}/" in f for b in touched):
            Path(f).write_bytes(b"no table")
    got = {r.rowid: (r.status, r.layer) for r in store.feed(batch, start + 250 * HOUR).collect()}
    # the hash is known at any age; the title and words of the first day have left their windows
    assert got == {60: ("dupe", 0), 61: ("new", None), 62: ("dupe", 1), 63: ("new", None)}


def test_a_batch_that_failed_between_its_writes(spark, tmp_path):
    store = Decisions(spark, str(tmp_path / "s"), buckets=2)
    batch = spark.createDataFrame([(i, f"h{i % 7}", f"t{i}", f"aa{i} bb{i}", "p", None) for i in range(20)], FORM)
    store.ids.add(batch.where("rowid < 7").select("id_hash", "rowid"), ["rowid"])
    got = {r.rowid: r.layer for r in store.feed(batch, 1704067200.0).collect()}
    assert got == {i: None if i < 7 else 0 for i in range(20)}


def test_query_of_the_cascade_by_batches(spark, sf):
    got = {r.rowid: (r.status, r.layer) for r in catalog.QUERIES["dd5_batches"](spark, sf).collect()}
    vectors = {r.vec_id: list(r.embedding) for r in views.read(spark, sf, "embeddings").collect()}
    items = sorted(views.items(spark, sf).collect(), key=lambda r: r.rowid)
    last, batches = items[-1].rowid, []
    for b in range(4):
        rows = [r for r in items if r.rowid * 4 // (last + 1) == b]
        batches.append((max(r.created_at for r in rows), [(r.rowid, r.id_hash, r.title_hash, r.title, None, vectors.get(r.rowid)) for r in rows]))
    import re

    global like
    plain, like = like, lambda a, b: (lambda x, y: len(x & y) / len(x | y) if x | y else 1.0)(*({w for w in re.findall(r"\w+", t.lower()) if len(w) > 1} for t in (a, b)))
    try:
        assert got == scan(batches, (2, 1, 2))
    finally:
        like = plain
