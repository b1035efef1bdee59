"""Polled feeds as a data source: every entry once, over restarts and replays."""

import random

from tidewire.sources.feed_source import FeedSource, _Polls, entries

RSS = "<rss><channel>{}</channel></rss>"
ITEM = "<item><title>t {0}</title><link>https://x/{0}</link><pubDate>Tue, 05 Mar 2024 06:07:08 GMT</pubDate><description>d &amp; e</description></item>"


def write(folder, host, feed, poll, ids, odd=None):
    path = folder / host / feed
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{poll:06}.xml").write_text(odd if odd is not None else RSS.format("".join(ITEM.format(i) for i in ids)))


def run(spark, folder, tmp_path, turn):
    query = spark.readStream.format("feeds").load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.feed, r.link) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    rng, folder, want = random.Random(2), tmp_path / "polls", set()
    state = {(h, f): 0 for h in ("a.example", "b.example") for f in ("f1", "f2", "f3")}
    poll = dict.fromkeys(state, 0)
    for turn in range(4):
        for (h, f), newest in state.items():
            for _ in range(rng.randint(0, 3)):
                newest += rng.randint(0, 4)
                poll[h, f] += 1
                shown = [f"{h}-{f}-{i}" for i in range(newest, max(newest - 5, 0), -1)]
                write(folder, h, f, poll[h, f], shown, odd="<html>busy" if rng.random() < 0.1 else None)
                if "busy" not in (folder / h / f / f"{poll[h, f]:06}.xml").read_text():
                    want |= {(f, f"https://x/{i}") for i in shown}
            state[h, f] = newest
        assert run(spark, folder, tmp_path, turn) == sorted(want)  # a new query each time, from the checkpoint
    again = spark.read.format("feeds").option("lanes", "3").load(str(folder))
    assert sorted((r.feed, r.link) for r in again.collect()) == sorted(want) and again.rdd.getNumPartitions() >= 3
    assert again.where("link like '%a.example-f1-1'").first().summary == "d & e"


def test_the_same_offsets_give_the_same_rows(tmp_path):
    folder = tmp_path / "polls"
    write(folder, "h", "f", 1, [3, 2, 1])
    write(folder, "h", "f", 2, [5, 4, 3, 3])
    polls = _Polls({"path": str(folder)})
    (lane,) = polls.lanes_of({"h/f": 1}, {"h/f": 2})
    first = list(polls.read(lane))
    write(folder, "h", "f", 3, [9])  # what comes later changes nothing
    assert list(polls.read(lane)) == first and [r[5] for r in first] == ["https://x/5", "https://x/4"]
    assert polls.lanes_of({"h/f": 3}, polls.last()) == []


def test_a_failed_poll_hides_nothing(tmp_path):
    folder = tmp_path / "polls"
    for poll, ids in enumerate(([2, 1], None, [3, 2, 1], None, None, [4, 3]), 1):
        write(folder, "h", "f", poll, ids or [], odd=None if ids else "<html>busy")
    polls = _Polls({"path": str(folder)})
    for cut in range(1, 6):  # a restart after any poll
        lanes = polls.lanes_of({}, {"h/f": cut}) + polls.lanes_of({"h/f": cut}, {"h/f": 6})
        assert [r[5][-1] for lane in lanes for r in polls.read(lane)] == ["2", "1", "3", "4"]


def test_entries_of_other_shapes(spark, tmp_path):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>A</title><link rel="self" href="s"/><link href="https://a"/><updated>2024-01-02</updated><summary>s</summary></entry><entry><title>no link</title></entry></feed>'
    assert entries(atom.encode()) == [("A", "https://a", "2024-01-02", "s")]
    assert entries(b"") == entries(b"not a feed") == []
    spark.dataSource.register(FeedSource)
    (tmp_path / "none").mkdir()
    assert spark.read.format("feeds").load(str(tmp_path / "none")).count() == 0
