"""The read entry point, reports, what readers keep, calls out, upkeep and windows."""

import json
import random
import time
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tests.test_operators import sequential
from tidewire.operators import cascade, feed, runs, saved, store
from tidewire.plans import serving, views
from tidewire.sources import readers, targets
from tidewire.streaming import jobs


def test_every_page_of_the_read_api_once(spark, sf):
    rows = views.articles(spark, sf).cache()
    asked, got = {"limit": "10", "company": "src0,src1, src2"}, []
    while True:
        page, cursor = feed.articles(rows, asked)
        got += [r.sort_key for r in page.collect()]
        if cursor is None:
            break
        asked = asked | {"cursor": cursor}
    want = feed.keyed(store.public(rows)).where("tag rlike 'src[012]( *,|$)'").collect()
    assert got == sorted((r.sort_key for r in want), reverse=True) and len(got) > 20


@pytest.mark.parametrize("params", [{"limit": "0"}, {"limit": "x"}, {"kind": "podcast"}, {"company": " , "}])
def test_read_api_refuses(spark, sf, params):
    with pytest.raises(ValueError):
        feed.articles(views.articles(spark, sf), params)


def test_reports(spark):
    none = spark.createDataFrame([], "source string, status string, found long, new long, duplicate long, error string")
    assert tuple(runs.collect_totals(none).first()) == (0, 0, 0, 0, 0)
    rows = spark.createDataFrame([("fetch", 1.0, 3.5, False, {"b": "2", "a": "1"}), ("rest", 1.0, 1.0, True, None)], "stage string, started_at double, ended_at double, success boolean, details map<string,string>")
    assert [r.text for r in runs.stage_lines(rows).orderBy("stage").collect()] == ["  [FAIL] fetch (2.5s)\n         a: 1\n         b: 2", "  [OK] rest (0.0s)"]


def test_toggles_one_by_one(spark):
    rng = random.Random(1)
    events = [(u, str(rng.randint(0, 9)), t) for t, u in enumerate(rng.choices("ab", k=200))]
    held: dict[str, OrderedDict] = {"a": OrderedDict(), "b": OrderedDict()}
    for u, h, t in events:
        if t == 90:
            held["a"].clear()
        if h in held[u]:
            del held[u][h]
        else:
            held[u][h] = t
    schema = "user_id string, article_hash string, at long"
    out = saved.toggled(spark.createDataFrame([], schema), spark.createDataFrame(events, schema), spark.createDataFrame([("a", 89)], "user_id string, at long"))
    assert {(r.user_id, r.article_hash, r["at"]) for r in out.collect()} == {(u, h, t) for u in held for h, t in held[u].items()}


def test_recent_articles_one_by_one(spark, sf):
    caches: dict[str, OrderedDict] = {}
    for r in views.read(spark, sf, "events").orderBy("event_id").collect():
        own = caches.setdefault(str(r.user_id), OrderedDict())
        own[str(r.event_id * 7 % 131)] = float(r.event_id)
        if len(own) > 20:
            own.popitem(last=False)
    want = {(s, h, at) for s, own in caches.items() for h, at in own.items()}
    assert {tuple(r) for r in serving.lim_cache50(spark, sf).collect()} == want
    # a hash that is held keeps its place; one that went comes in anew
    rows = spark.createDataFrame([("s", h, t) for t, h in enumerate("abacab")] + [(None, "x", 1), ("t", None, 1)], "session string, article_hash string, at long")
    assert {(r.article_hash, r["at"]) for r in saved.recent(rows, 2).collect()} == {("a", 4.0), ("b", 5.0)}
    assert saved.recent(rows.limit(0)).count() == 0


def test_company_list_order(spark):
    names = spark.createDataFrame([("Zeta",), ("élan",), ("Echo",), ("alpha",), ("",), (None,), ("Echo",)], "company string")
    assert [r.company for r in saved.company_list(names).collect()] == ["alpha", "Echo", "élan", "Zeta"]


def test_summaries_try_again(spark, tmp_path):
    def answer(t):
        seen = tmp_path / t
        n = int(seen.read_text()) if seen.exists() else 0
        seen.write_text(str(n + 1))
        if t == "down" or (t == "once" and n == 0):
            raise ConnectionError("no route")
        if t == "bad":
            raise ValueError("junk")
        return t.upper()

    rows = spark.createDataFrame([(t, t) for t in ("once", "down", "bad", "fine")], "article_hash string, content string")
    got = {r.article_hash: (r.raw, r.error) for r in readers.summarized(rows, answer, base=0.01).collect()}
    assert got == {"once": ("ONCE", None), "down": (None, "no route"), "bad": (None, "junk"), "fine": ("FINE", None)}
    assert [(tmp_path / t).read_text() for t in ("once", "down", "bad", "fine")] == ["2", "3", "1", "1"]
    asked = rows.select(readers.summary_prompt(F.lit("T"), F.lit("x" * 12), 10).alias("p")).first().p
    assert asked == "Title: T\n\nContent:\n" + "x" * 10 + "\n\n[...truncated...]"


def test_embedding(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "x" * 3000 if i else None) for i in range(7)], "rowid long, title string, excerpt string")
    got = {r.rowid: r.embedding for r in readers.embedded(rows, lambda ts: [[float(len(t)), 1.0] for t in ts], batch=2).collect()}
    assert got == {i: [2004.0 if i else 4.0, 1.0] for i in range(7)}
    assert readers.embedded(rows.limit(0), lambda ts: []).count() == 0
    with pytest.raises(Exception, match="texts gave 0 vectors"):
        readers.embedded(rows, lambda ts: []).collect()


def test_judge(spark):
    items = spark.createDataFrame([(1, "one", "first"), (2, "two", None), (3, "three", "y" * 500)], "rowid long, title string, excerpt string")

    def ask(prompt):
        assert len(prompt) < 1000 and prompt.endswith("same, different, related.")
        if "title: three" in prompt:
            raise RuntimeError("down")
        assert "Item B excerpt: one" not in prompt and "Item A excerpt: two" in prompt
        return "**Same**, I think"

    pairs = spark.createDataFrame([(2, 1), (3, 1), (2, 1)], "a long, b long")
    assert [tuple(r) for r in readers.judged(pairs, items, ask).collect()] == [(2, 1)]


def test_polite_fetching_spaces_a_host(spark):
    rows = spark.createDataFrame([(f"https://Slow.example/{i}",) for i in range(5)] + [("not a url",)], "url string")
    out = readers.fetched_politely(rows, lambda u: str(time.time()), lanes=0, delay=0.2, jitter=0.0).collect()
    at = sorted(float(r.body) for r in out if r.url != "not a url")
    assert len(out) == 6 and min(b - a for a, b in zip(at, at[1:], strict=False)) > 0.19


def test_spacing_one_by_one(spark):
    rng = random.Random(3)
    rows = [(h, i, rng.randint(0, 40) / 4) for i, h in enumerate(rng.choices("xy", k=60))]
    want, last = {}, {}
    for h, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        last[h] = want[i] = max(at, last.get(h, -1e9) + 0.5)
    got = jobs.spaced(spark.createDataFrame(rows, "host string, id long, at double"), 0.5).collect()
    assert {r.id: r.start for r in got} == pytest.approx(want)


def test_cascade_windows(spark):
    rng = random.Random(5)
    rows = [(i, f"h{rng.randint(0, 80)}", f"t{rng.randint(0, 40)}", " ".join(rng.sample([f"w{k}" for k in range(14)], rng.randint(1, 4))), 3600.0 * i) for i in range(50)]
    near = list({(a, b): (a, b, 0.9) for a in range(50) for b in rng.sample(range(50), 3) if b < a}.values())
    now, hours = 3600.0 * 49, (20, 10, 15)
    new, want = [], {}
    for i, ih, th, t, _ in rows:  # a row's match must lie in its layer's window
        def live(x, layer):
            return x[4] >= now - 3600 * hours[layer]

        def like(x):
            a, b = set(x[3].split()), set(t.split())
            return len(a & b) / len(a | b)

        near_by = {b for a, b, _ in near if a == i}
        layer = next((k for k, hit in enumerate((lambda x: x[1] == ih, lambda x: x[2] == th and live(x, 0), lambda x: like(x) > 0.4 and live(x, 1), lambda x: x[0] in near_by and live(x, 2))) if any(hit(x) for x in new)), None)
        want[i] = ("new" if layer is None else "dupe", layer)
        if layer is None:
            new.append((i, ih, th, t, 3600.0 * i))
    items = spark.createDataFrame(rows, "rowid long, id_hash string, title_hash string, title string, created_at double")
    edges = spark.createDataFrame(near, "a long, b long, score double")
    assert {r.rowid: (r.status, r.layer) for r in cascade.resolve(items, edges, now=now, hours=hours).collect()} == want
    assert {r.rowid: (r.status, r.layer) for r in cascade.resolve(items, edges, now=now, hours=(99, 99, 99)).collect()} == sequential([r[:4] for r in rows], near)


def test_stream_judged_by_the_clock(spark, tmp_path):
    def run(rows, turn, now):
        spark.createDataFrame(rows, "rowid long, title_hash string").write.mode("append").parquet(str(tmp_path / f"in{turn}"))
        stream = spark.readStream.schema("rowid long, title_hash string").parquet(str(tmp_path / f"in{turn}"))
        jobs.ingest_windowed(stream, str(tmp_path / "store"), str(tmp_path / f"c{turn}"), lambda: now, hours=1)

    run([(1, "a"), (2, "a"), (3, "b")], 1, 0.0)
    run([(4, "a"), (1, "a")], 2, 1800.0)  # within the hour; 1 is there already
    run([(5, "a"), (6, "b")], 3, 5000.0)  # the hour is over
    got = {r.rowid: (r.status, r.match) for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert got == {1: ("new", None), 2: ("dupe", 1), 3: ("new", None), 4: ("dupe", 1), 5: ("new", None), 6: ("new", None)}


def test_upkeep(spark):
    spark.sql("DROP TABLE IF EXISTS upkeep")
    assert store.ensure(spark, "upkeep", "article_hash string, n int").count() == 0
    spark.sql("INSERT INTO upkeep VALUES ('a', 1), ('b', 2)")
    assert store.ensure(spark, "upkeep", "article_hash string, n int").count() == 2
    assert store.cleared(spark, "upkeep") == 2 and spark.table("upkeep").count() == 2
    assert store.cleared(spark, "upkeep", sure=True) == 2 and spark.table("upkeep").count() == 0
    spark.sql("DROP TABLE upkeep")
    ids = store.numbered(spark.range(1000).selectExpr("id % 7 as k", "id"), ["k", "id"], 10).orderBy("k", "id").collect()
    assert [r.rowid for r in ids] == list(range(11, 1011))


def test_targets(spark):
    rows = targets.targets(spark, ["targets: [{slug: a, url: 'https://a'}, {slug: b, url: 'https://b'}]", "", "targets: [{slug: a, url: 'https://A', title: New}]"])
    assert [(r.slug, r.url, r.file, r.pos) for r in targets.merged(rows).orderBy("file", "pos").collect()] == [("a", "https://A", 0, 0), ("b", "https://b", 0, 1)]

    def fetch(u):
        if u.endswith("b"):
            raise OSError("gone")
        return " body "

    got = {r.slug: (r.content, r.error) for r in targets.crawled(targets.merged(rows), fetch).collect()}
    assert got == {"a": ("# New\n\nURL: https://A\n\nbody", None), "b": (None, "gone")}
    assert targets.targets(spark, []).count() == 0


def test_feeds_of_both_kinds(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/"><entry><title>A</title><link rel="enclosure" type="image/png" href="e.png"/><link href="https://a/1"/><published>2024-01-02T00:00:00+01:00</published><updated>2025-01-01T00:00:00Z</updated><content>c</content></entry><entry><title>B</title><link rel="self" href="s"/></entry></feed>'
    rows = readers.rss_items(spark.createDataFrame([(1, atom), (2, "junk"), (3, None), (4, "<rss><channel/></rss>")], "id int, body string")).collect()
    assert [(r.id, r.pos, r.title, r.link, r.summary_text, r.image_url) for r in rows] == [(1, 0, "A", "https://a/1", "c", "e.png")]
    assert json.loads(json.dumps(rows[0].published.isoformat())).startswith("2024-01-01T23")
