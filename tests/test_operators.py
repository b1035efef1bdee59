import json
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import cascade, dedup, feed, similarity, store
from tidewire.plans import catalog
from tidewire.sources import readers, writers
from tidewire.streaming import jobs


def sequential(rows, near, over=0.4, high=0.85, low=0.75, same=frozenset()):
    """The reference rule: one row after the other, candidates are earlier new rows."""

    def words(t):
        import re

        return {w for w in re.findall(r"\w+", t.lower()) if len(w) > 1}

    def like(a, b):
        return 1.0 if not a | b else len(a & b) / len(a | b)

    new, out = [], {}
    for r in sorted(rows):
        i, ih, th, t = r
        layer = None
        if any(x[1] == ih for x in new):
            layer = 0
        elif any(x[2] == th for x in new):
            layer = 1
        elif any(like(words(x[3]), words(t)) > over for x in new):
            layer = 2
        elif any(s > high for a, b, s in near if a == i and b in {x[0] for x in new}):
            layer = 3
        elif any(low < s <= high and (a, b) in same for a, b, s in near if a == i and b in {x[0] for x in new}):
            layer = 4
        out[i] = ("new" if layer is None else "dupe", layer)
        if layer is None:
            new.append(r)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_cascade_matches_a_sequential_scan(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(14)]
    rows = [(i, f"h{rng.randint(0, 60)}", f"t{rng.randint(0, 50)}", " ".join(rng.sample(vocabulary, rng.randint(0, 5)))) for i in range(60)]
    near = [(a, b, round(rng.uniform(0.7, 0.95), 3)) for a in range(60) for b in rng.sample(range(60), 3) if b < a]
    near = list({(a, b): (a, b, s) for a, b, s in near}.values())
    same = frozenset((a, b) for a, b, _ in near if (a + b) % 2)
    items = spark.createDataFrame(rows, "rowid long, id_hash string, title_hash string, title string")
    edges = spark.createDataFrame(near, "a long, b long, score double")
    got = {r.rowid: (r.status, r.layer) for r in cascade.resolve(items, edges, judge=lambda d: d.where((F.col("a") + F.col("b")) % 2 == 1)).collect()}
    assert got == sequential(rows, near, same=same)


def test_cascade_query_with_a_group_of_near_copies(spark, tmp_path):
    rng = random.Random(4)
    vectors = [[1.0, 0.0, 0.0, 0.0]] + [[1.0, *(rng.uniform(-0.8, 0.8) for _ in range(3))] for _ in range(49)]
    spark.createDataFrame([(i, f"w{i}", "s") for i in range(50)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    near = [(a, b, s) for a in range(50) for s, b in sorted(((cosine(vectors[a], vectors[b]), b) for b in range(a)), reverse=True)[:10]]
    got = {r.rowid: (r.status, r.layer) for r in catalog.QUERIES["dd5_cascade"](spark, str(tmp_path)).collect()}
    assert got == sequential([(i, f"h{i}", f"t{i}", f"w{i}") for i in range(50)], near)


def test_first_similar_matches_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 8)))) for i in range(120)]
    got = {r.id: r.match for r in similarity.first_similar(spark.createDataFrame(rows, "rowid long, title string")).collect()}
    sets = {i: set(t.split()) for i, t in rows}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    want = {i: next((j for j in range(i) if like(sets[j], sets[i]) > 0.4), None) for i in sets}
    assert got == {i: j for i, j in want.items() if j is not None}


def articles(spark, rows):
    return spark.createDataFrame([(f"h{i}", pub, f"2024-01-{i:02d}T00:00:00Z", tag, kind, status, decision, f"T{i}") for i, (pub, tag, kind, status, decision) in enumerate(rows, 1)], "article_hash string, published_at string, collected_at string, tag string, content_kind string, summary_status string, dedup_decision string, title string")


def test_feed_pages_and_filters(spark):
    rows = articles(spark, [("2024-02-01", "A,B", None, None, None), ("2024-02-03", "B", "social", "irrelevant", ""), ("2024-02-02T10:00:00", "A", "news", "pending", "new"), ("", " C , A ", "news", "failed", "duplicate"), ("2024-02-02", "B", "social", "ai_generated", "")])
    newest = [r.article_hash for r in feed.latest(rows).collect()]
    assert newest == ["h3", "h5", "h1"]
    first = feed.latest(rows, 2).collect()
    rest = feed.latest(rows, 2, cursor=feed_cursor(first[-1].sort_key)).collect()
    assert [r.article_hash for r in first + rest] == newest
    assert [r.article_hash for r in feed.latest(rows, kind="news").collect()] == ["h3", "h1"]
    got = feed.of_companies(rows, ["B", "A"], since="2024-02-01", until="2024-02-02").collect()
    assert [(r.article_hash, r.company) for r in got] == [("h3", "A"), ("h5", "B"), ("h1", "B")]
    for bad in ("0", -1, "x", True):
        with pytest.raises(ValueError):
            feed.checked_limit(bad)
    assert feed.checked_limit("500") == 100 and feed.checked_limit() == 20
    with pytest.raises(ValueError):
        feed.checked_kind("x")
    with pytest.raises(ValueError):
        feed.of_companies(rows, [""])


def feed_cursor(key):
    from tidewire.functions.payloads import encode_cursor

    return encode_cursor({"sort_key": key})


def test_public_shape_leaks_nothing(spark):
    row = spark.createDataFrame([("h", "Firm", "i.png", "secret")], "article_hash string, company string, image_url string, raw_link string")
    got = store.public_shape(row).first().asDict()
    assert len(got) == 16 and "raw_link" not in got
    assert got["companies"] == ["Firm"] and got["image_urls"] == ["i.png"] and got["content_kind"] == "news" and got["summary"] == ""


def test_store_inserts_once(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "article_hash string, pos int")
    kept = store.insert_new(rows, rows.limit(0), ["pos"])
    assert sorted(map(tuple, kept.collect())) == [("a", 1), ("b", 3)]
    assert store.insert_new(rows, kept, ["pos"]).count() == 0


def test_title_modes(spark):
    from tidewire.functions.text import stored_title_hash

    rows = spark.createDataFrame([("a", "Breaking: X", 1), ("b", "x", 2), ("c", "x", 3), ("d", "y", 4)], "article_hash string, title string, n int").selectExpr("*", "concat('2024-01-0', n) as published_at", "concat('2024-01-0', n) as collected_at", "'pending' as summary_status").withColumn("title_hash", stored_title_hash(F.col("title")))
    assert sorted(map(tuple, dedup.title_duplicates(rows, "2024").collect())) == [("a", "c"), ("b", "c"), ("c", "b")]
    assert sorted(map(tuple, dedup.title_duplicates(rows, "2024", "keep_first").collect())) == [("b", "a"), ("c", "a")]


def test_feed_cap_after_filter_and_undated_last(spark):
    rows = spark.createDataFrame([("s", 0, "2020-01-01"), ("s", 1, None), ("s", 2, "2026-08-01"), ("s", 3, "2020-06-01")], "source string, pos long, d string").withColumn("published", F.to_timestamp("d"))
    order = lambda cap: [r.pos for r in feed.newest_per_feed(rows, cap, min_date=F.lit("2020-03-01").cast("timestamp")).orderBy("rank").collect()]
    assert order(9) == [2, 3, 1] and order(0) == [] and order(None) == [2, 3]


def test_rss(spark):
    body = """<rss><channel><item><title>A &amp;amp; b - Paper</title><link>https://x/1</link><pubDate>Tue, 05 Mar 2024 06:07:08 GMT</pubDate><source>Wire</source><enclosure url="i.png" type="image/png"/><description>&lt;p&gt;t&lt;/p&gt;</description></item><item><title>B - Paper</title><link>https://x/2</link><pubDate>never</pubDate></item><item><title>C</title></item></channel></rss>"""
    a, b = readers.rss_items(spark.createDataFrame([(body,)], "body string")).orderBy("pos").collect()
    assert (a.title, a.publisher, a.summary_text, a.image_url, a.published.year) == ("A & b - Paper", "Wire", "t", "i.png", 2024)
    assert (b.publisher, b.published, b.image_url) == ("Paper", None, "")


def test_raw_markdown(spark, tmp_path):
    (tmp_path / "b.md").write_text("# The title \n\nURL: https://x/y\n\n body here")
    (tmp_path / "a.md").write_text("just text")
    rows = readers.read_markdown(spark, str(tmp_path)).orderBy("slug").collect()
    assert [(r.slug, r.title, r.url, r.excerpt) for r in rows] == [("a", None, None, "just text"), ("b", "The title", "https://x/y", "body here")]


def test_entry_image(spark):
    kind = "array<struct<url:string,type:string>>"
    rows = [([("", "image"), ("v.mp4", "video/mp4"), ("m.png", "")], [("t.png", None)], []), ([], [("t.png", None)], []), ([], [], [("e.mp3", "audio/x"), ("e.png", "image/png")]), (None, None, None)]
    out = spark.createDataFrame(rows, f"a {kind}, b {kind}, c {kind}").select(readers.entry_image(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in out] == ["m.png", "t.png", "e.png", ""]


def test_callables_isolate_failures(spark):
    def fetch(u):
        if u.endswith("bad"):
            raise ValueError("no")
        return u.upper()

    got = {r.url: (r.body, r.error) for r in readers.fetched(spark.createDataFrame([("ok",), ("ok",), ("bad",)], "url string"), fetch).collect()}
    assert got == {"ok": ("OK", None), "bad": (None, "no")}
    links = spark.createDataFrame([("https://news.google.com/1",), ("https://news.google.com/bad",), ("https://x",)], "link string")
    out = {r.link: (r.resolved_link, r.resolve_status) for r in readers.resolved(links, lambda u: "https://real/" if u.endswith("1") else "https://news.google.com/again").collect()}
    assert out == {"https://news.google.com/1": ("https://real/", "ok"), "https://news.google.com/bad": (None, "failed"), "https://x": ("https://x", "skipped")}
    raw = readers.summarized(spark.createDataFrame([("h", "t"), ("g", "")], "article_hash string, content string"), lambda t: t and json.dumps({"summary": t})).collect()
    assert {r.article_hash: r.error for r in raw} == {"h": None, "g": "empty answer"}


def test_quotes(spark):
    wanted = spark.createDataFrame([("A", "Alpha")], "symbol string, company string")
    payload = lambda x: spark.createDataFrame([(json.dumps(x),)], "payload string")
    assert readers.quotes(payload({"A": {"symbol": "A", "close": "1.5", "percent_change": "2"}, "Z": {"symbol": "Z", "close": "1", "percent_change": "1"}}), wanted).count() == 1
    assert readers.quotes(payload({"symbol": "A", "close": "1.5", "percent_change": "2"}), wanted).first().price == 1.5
    assert readers.quotes(payload({"A": {"symbol": "A", "status": "error"}}), wanted).count() == 0
    snap = payload({"items": [{"company": "B", "price": 1.0, "change_percent": -1.0, "currency": "EUR"}, {"company": "C"}]})
    assert [r.symbol for r in readers.snapshot_quotes(snap).collect()] == ["B"]
    rows = spark.createDataFrame([("B", 1.0, 2.0, "EUR", "t")], "company string, price double, change_percent double, currency string, scraped_at string")
    assert json.loads(writers.quotes_json(rows).first().content)["items"][0]["company"] == "B"


def test_written_documents(spark, tmp_path):
    rows = spark.createDataFrame([("h1", "s1", "T", "u", "body")], "article_hash string, source_id string, title string, link string, markdown string")
    doc = writers.markdown(rows)
    assert doc.first().content.endswith("---\n\n# T\n\nURL: u\n\nbody")
    writers.write_documents(doc, str(tmp_path / "out"), "run1")
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).where("source_id = 's1'").count() == 1
    assert list(json.loads(writers.summary_json(rows).first().content)) == list(writers.SUMMARY)


def test_stream_ingest_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "article_hash string, pos int")
    rows.write.parquet(str(tmp_path / "in"))
    for turn in ("x", "y"):  # the second run sees everything again
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        jobs.ingest(stream, str(tmp_path / "store"), ["pos"], str(tmp_path / turn))
        assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_breaker_steps():
    state = (0, 0.0)
    for at, status, retry, want in ((1, 500, None, (1, 0.0)), (2, 500, None, (2, 0.0)), (3, 502, None, (3, 63.0)), (4, 200, None, (0, 0.0)), (5, 429, 999, (1, 305.0)), (6, 503, 0.2, (2, 7.0))):
        state = jobs.breaker_step(*state, at, status, retry)
        assert state == want


def test_session_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = jobs.read_events(spark, f"{sf}/events*.parquet", events.schema)
    out = jobs.drained(jobs.session_counts(stream, "user_id"), "append")
    assert out.agg(F.sum("n")).first()[0] <= events.count()
