"""Whole stage runs: the queue and the closed rows, runs that end in the middle, the command line over polls."""

import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from tidewire import __main__ as command
from tidewire.functions import rules
from tidewire.plans import stages
from tidewire.plans.stages import ArticleRuns, collected
from tidewire.sources import readers

ITEM = "source_id string, pos int, title string, link string, published_at string, summary_text string, image_url string"
SOURCES = [("s1", "S1", "auto", None), ("s2", "S2", "outros", None), ("s3", "S3", "auto", "linkedin_company")]
ITEMS = [
    ("s1", 0, "One motor", "http://a/1", "2024-01-01T00:00:00+00:00", "text one", None),
    ("s1", 1, "Two", "http://a/2", "", "text two", "http://i/own.png"),
    ("s1", 2, "Old", "http://a/3", "2020-01-01T00:00:00Z", "t", None),
    ("s2", 0, "One motor", "http://a/1", None, "x", None),
    ("s2", 1, "Three", "http://b/3", None, "x", None),
    ("s3", 0, "", "http://l/1", None, "post", None),
    ("s1", 5, "One motor", "http://a/9", "", "again", None),
    ("s1", 5, "One motor", "http://a/9", "", "again", None),
    ("s1", 6, "x", None, "", "", None),
    ("unknown", 0, "x", "http://u/1", "", "", None),
]


def page(url):
    if url.endswith("/2"):
        raise OSError("refused")
    return f'<html><head><meta property="og:image" content="http://i/x.png"></head><body>hello {url}</body></html>'


def answer(prompt):
    if "Two" in prompt:
        raise ValueError("no")
    return json.dumps({"summary": "S", "relevant": "post" not in prompt, "title": "New " + prompt[7:10], "event_type": "Evento"})


@pytest.fixture(scope="module")
def sources(spark):
    return readers.with_defaults(spark.createDataFrame(SOURCES, "source_id string, name string, category string, feed_type string"))


def cutoff():
    return F.lit("2023-12-01 00:00:00").cast("timestamp")


def state_of(runs):
    return sorted((r.link, r.summary_status, r.dedup_decision) for r in runs.articles.collect())


def test_a_run_from_collection_to_summaries(spark, sources, tmp_path):
    runs = ArticleRuns(spark, str(tmp_path / "store"), 4, 64)
    items = spark.createDataFrame(ITEMS, ITEM)
    funnel = runs.collect(items, sources, "2024-01-02T00:00:00Z", cutoff()).rows
    got = {r.source_id: (r.found, r.dropped_cutoff, r.dropped_raw_dedup, r.dropped_hash_dedup, r.dropped_unresolved, r.new) for r in funnel.collect()}
    assert got == {"s1": (6, 1, 0, 1, 1, 3), "s2": (2, 0, 0, 1, 0, 1), "s3": (1, 0, 0, 0, 0, 1)}
    errors = spark.createDataFrame([("s3", "HTTP 500")], "source_id string, error string")
    assert collected(funnel, sources, errors) == {"success": False, "sources_ok": 2, "sources_error": 1, "items_found": 8, "items_new": 4, "items_duplicate": 2}
    again = runs.collect(items, sources, "2024-01-03T00:00:00Z", cutoff()).rows.agg(F.sum("new"), F.sum("dropped_raw_dedup")).first()
    assert tuple(again) == (0, 7) and runs.articles.count() == 5
    # only the queue's categories wait
    assert runs.queue.count() == 4 and [r.link for r in runs.closed().collect()] == ["http://b/3"]
    social = runs.articles.where("source_id = 's3'").first()
    assert (social.title, social.published_at, social.content_kind) == ("S3 LinkedIn post", "2024-01-02", "social")
    assert runs.dedup() == {"total": 4, "new": 3, "duplicates": 1}
    assert runs.classify() == {"updated": 3}
    twice = runs.articles.where("dedup_decision = 'duplicate'").first()
    assert twice.title == "One motor" and twice.dedup_reason == "same_title" and twice.dedup_match_hash
    pages = str(tmp_path / "pages")
    assert runs.fetch(page, pages, "R1") == {"total": 3, "fetched": 2, "failed": 1}
    images = {r.link: r.image_url for r in runs.queue.collect()}
    assert images["http://a/2"] == "http://i/own.png" and images["http://l/1"] == "" and "http://i/x.png" in images.values()
    assert "post" in "\n".join(r.value for r in spark.read.text(f"{pages}/run_ts=R1/source_id=s3").collect())
    assert runs.summarize(answer, "2024-01-03T01:00:00Z", "m", folder=str(tmp_path / "sums"), run="R1") == {"total": 3, "summarized": 1, "irrelevant": 1, "failed": 1}
    done = runs.articles.where("summary_status = 'ai_generated'").first()
    assert (done.title, done.summary, done.ai_model, done.event_type, done.ai_processed_at) == ("New One", "S", "m", "Evento", "2024-01-03T01:00:00Z")
    assert json.loads(spark.read.text(str(tmp_path / "sums")).first().value)["summary"] == "S"
    assert runs.queue.first().extra == "no"
    assert runs.retry() == {"reset": 1} and runs.queue.first().summary_status == "pending"
    before = state_of(runs)
    runs.compact()
    assert state_of(runs) == before and len(runs.state.closed) == 1
    assert {(r.section, r.name): r.n for r in runs.status(sources).collect()}["articles", "visible"] == 4


def test_runs_that_end_in_the_middle(spark, sources, tmp_path, monkeypatch):
    runs = ArticleRuns(spark, str(tmp_path / "store"), 4, 64)
    items = spark.createDataFrame(ITEMS, ITEM)
    put = ArticleRuns._put

    def broken(self, state):
        raise OSError("lost")

    # before its file is there, a run has not happened
    monkeypatch.setattr(ArticleRuns, "_put", broken)
    with pytest.raises(OSError):
        runs.collect(items, sources, "2024-01-02T00:00:00Z", cutoff())
    monkeypatch.setattr(ArticleRuns, "_put", put)
    assert runs.state == stages.State() and runs.articles.count() == 0
    # after that, its keys are added by the next run
    settle = ArticleRuns._settle
    calls = []
    monkeypatch.setattr(ArticleRuns, "_settle", lambda self: calls.append(1) or (settle(self) if len(calls) != 2 else broken(self, None)))
    with pytest.raises(OSError):
        runs.collect(items, sources, "2024-01-02T00:00:00Z", cutoff())
    assert runs.state.unkeyed == 1 and runs.hashes.rows.count() == 0
    assert runs.collect(items, sources, "2024-01-02T00:00:00Z", cutoff()).rows.agg(F.sum("new")).first()[0] == 0
    assert runs.articles.count() == 5 == runs.hashes.rows.count()
    # a stage that fails is reported and changes nothing
    held = runs.state
    with pytest.raises(RuntimeError):
        runs.staged("dedup", lambda: (_ for _ in ()).throw(RuntimeError("no room")))
    line = runs.report().first()
    assert line.text.startswith("  [FAIL] dedup") and "no room" in line.text and runs.state == held
    # a second writer of the same run is refused
    with pytest.raises(RuntimeError, match="another writer"):
        runs._put(held)


def test_a_dedup_run_reads_only_days_that_can_matter(spark, sources, tmp_path):
    runs = ArticleRuns(spark, str(tmp_path / "store"), 4, 64)
    days = {"01": "Far", "20": "Near", "22": "Both"}
    for k, (day, title) in enumerate(days.items()):
        items = spark.createDataFrame([("s2", 0, title, f"http://{k}/1", "", "x", None)], ITEM)
        runs.collect(items, sources, f"2024-01-{day}T00:00:00Z")
    late = [("s1", i, t, f"http://late/{i}", "", "x", None) for i, t in enumerate(["Far", "Near", "Both", "Alone"])]
    runs.collect(spark.createDataFrame(late, ITEM), sources, "2024-01-22T12:00:00Z")
    for top, _, names in os.walk(tmp_path / "store" / "closed"):
        if top.endswith("day=2024-01-01"):
            for name in names:
                with open(f"{top}/{name}", "wb") as f:
                    f.write(b"not a table")
    spark.catalog.clearCache()
    assert runs.dedup() == {"total": 4, "new": 2, "duplicates": 2}
    assert sorted(r.title for r in runs.queue.collect()) == ["Alone", "Far"]


def test_empty_stages(spark, sources, tmp_path):
    runs = ArticleRuns(spark, str(tmp_path / "store"), 4, 64)
    assert runs.dedup() == {"total": 0, "new": 0, "duplicates": 0} and runs.classify() == {"updated": 0} and runs.retry() == {"reset": 0}
    assert runs.summarize(answer, "2024-01-01T00:00:00Z") == {"total": 0, "summarized": 0, "irrelevant": 0, "failed": 0}
    assert runs.fetch(page, str(tmp_path / "p"), "R") == {"total": 0, "fetched": 0, "failed": 0}
    assert runs.collect(spark.createDataFrame([], ITEM), sources, "2024-01-01T00:00:00Z").rows.count() == 0 == runs.articles.count()


RSS = "<rss><channel>{}</channel></rss>"
ENTRY = "<item><title>{0}</title><link>http://x/{0}</link><pubDate>Mon, 01 Jan 2024 0{1}:00:00 GMT</pubDate><description>about {0}</description></item>"


def test_command_line_over_polls(spark, tmp_path, capsys):
    (tmp_path / "sources.yaml").write_text("sources:\n- {source_id: f1, name: F1, rss_url: 'http://h/f1', tag: A}\n- {source_id: f2, name: F2, rss_url: 'http://h/f2', tag: B, active: false}\n")
    polls = tmp_path / "polls" / "h" / "f1"
    polls.mkdir(parents=True)
    (polls / "1.xml").write_text(RSS.format(ENTRY.format("a", 1) + ENTRY.format("b", 2)))
    common = ["--store", str(tmp_path / "store"), "--sources", str(tmp_path / "sources.yaml"), "--polls", str(tmp_path / "polls"), "--buckets", "4"]
    noon = 1704110400.0  # of that day
    ticks = itertools.count()
    now = lambda: noon + next(ticks)
    first = command.main([*common, "--asker", "tests.test_stages:answer"], spark, now)
    assert first[0] == "fetch: not configured, skipping"
    assert [line.split("\n")[0] for line in first[1:]] == ["  [OK] collect (1.0s)", "  [OK] dedup (1.0s)", "  [OK] summarize (2.0s)"]
    assert "items_new: 2" in "".join(first) and "summarized: 2" in "".join(first)
    (polls / "2.xml").write_text(RSS.format(ENTRY.format("b", 2) + ENTRY.format("c", 3)))
    second = "\n".join(command.main([*common, "--collect", "--status", "--companies", "A"], spark, lambda: now() + 600))
    assert "items_found: 1" in second and "items_new: 1" in second and "articles visible: 3" in second
    wide = "\n".join(command.main([*common, "--collect", "--backfill"], spark, lambda: now() + 1200))
    assert "items_found: 3" in wide and "items_new: 0" in wide and "items_duplicate: 3" in wide
    assert command.main([*common, "--sources-list"], spark)[:2] == ["[active] f1: F1 (concorrente/auto)", "[disabled] f2: F2 (concorrente/auto)"]
    assert "sources active: 1" in capsys.readouterr().out


def test_words_out_of_scope_in_one_pass(spark):
    texts = ["", None, "a plain engine", "x" * 50_000, *(f"İ {w.upper()}!" for w in rules.OUT_OF_SCOPE), *(w[:-1] for w in rules.OUT_OF_SCOPE)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(F.coalesce(rules.out_of_scope(F.col("t")), F.lit(False)).alias("a"), rules.out_of_scope_by_batches(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(r.b for r in got) >= len(rules.OUT_OF_SCOPE)
