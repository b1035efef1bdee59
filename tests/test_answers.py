"""Answers kept between runs: each key is asked for once, failures when they are due and not before."""

import glob

from tidewire.operators.answers import Answers, resolved


def asker(folder, run, bad):
    """Notes what is asked in files, as tasks run elsewhere."""

    def ask(key):
        with open(f"{folder}/{run}-{key.rsplit('/', 1)[1]}", "a") as f:
            f.write("x")
        if "gone" in key:
            raise ValueError("no such page")
        if key in bad:
            raise ConnectionError("refused")
        return "" if "empty" in key else key.upper()

    return ask


def asked(folder, run):
    found = {f.rsplit("-", 1)[1]: len(open(f).read()) for f in glob.glob(f"{folder}/{run}-*")}
    assert all(n == 1 for n in found.values())
    return set(found)


def test_runs_ask_once_and_again_when_due(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    kept = Answers(spark, str(tmp_path / "kept"), attempts=3, base=60.0)
    names = ["a", "b", "c", "gone", "empty"]
    keys = spark.createDataFrame([(f"https://h{i % 2}/{n}",) for i, n in enumerate(names)] + [(f"https://h{i % 2}/{n}",) for i, n in enumerate(names)] + [(None,)], "key string")
    bad = {"https://h1/b", "https://h0/c"}
    got = []
    for run, (now, refused) in enumerate([(1000, bad), (1030, bad), (1060, {"https://h0/c"}), (1179, bad), (1180, bad), (9000, set())]):
        rows = kept.run(keys, asker(notes, run, refused), now).collect()
        got.append({r.key.rsplit("/", 1)[1]: r for r in rows})
        if run == 2:
            kept.compact()
    assert [asked(notes, k) for k in range(6)] == [set(names), set(), {"b", "c", "empty"}, set(), {"c", "empty"}, set()]
    last = got[-1]
    assert {n: (r.answer, r.attempts, r.due) for n, r in last.items()} == {"a": ("HTTPS://H0/A", 1, None), "b": ("HTTPS://H1/B", 2, None), "c": (None, 3, None), "gone": (None, 1, None), "empty": (None, 3, None)}
    assert last["b"].log == ["attempt 1: ConnectionError: refused; again in 60 s", "attempt 2: ok"] and last["gone"].exception == "ValueError: no such page"
    assert got[0]["b"].due == 1060 and got[2]["c"].due == 1180


def test_links_are_resolved_once_over_several_runs(spark, tmp_path):
    kept = Answers(spark, str(tmp_path / "kept"), attempts=2, base=10.0)
    links = spark.createDataFrame([(1, "https://news.google.com/x1"), (2, "https://news.google.com/x1"), (3, "https://plain.example/"), (4, "https://news.google.com/stays"), (5, None)], "id int, link string")
    first = {r.id: (r.resolved_link, r.resolve_status, r.resolve_attempts) for r in resolved(links, kept, lambda u: u if "stays" in u else "https://real/" + u[-2:], 0.0).collect()}
    assert first == {1: ("https://real/x1", "ok", 1), 2: ("https://real/x1", "ok", 1), 3: ("https://plain.example/", "skipped", 0), 4: (None, "waiting", 1), 5: (None, "skipped", 0)}

    def never(u):
        raise AssertionError("asked again")

    second = {r.id: (r.resolve_status, r.resolve_error) for r in resolved(links, kept, never, 5.0).collect()}
    assert second[1] == ("ok", None) and second[4] == ("waiting", "ConnectionError: still a wrapper")
    third = {r.id: r.resolve_status for r in resolved(links, kept, lambda u: u, 10.0).collect()}
    assert third == {1: "ok", 2: "ok", 3: "skipped", 4: "failed", 5: "skipped"}
