"""A title that is new asks its state for little."""

from pyspark.sql import Row

from tidewire.streaming.keyed_state import _Titles


def test_titles_ask_little_of_their_state():
    calls = []

    class Stand:
        held = None

        def __getattr__(self, name):
            return lambda *a: calls.append(name) or []

        def get(self):
            calls.append("get")
            return self.held

    titles = _Titles("", 3600.0)
    titles.state = titles.handle = Stand()
    rows = [Row(title_hash="a", rowid=r, created_at=at) for r, at in ((2, 10.0), (1, 0.0))]
    assert [(r.rowid, r.status, r.match) for r in titles.handleInputRows(("a",), iter(rows), None)] == [(1, "new", None), (2, "dupe", 1)]
    assert calls == ["get", "update", "registerTimer"]
    Stand.held, calls[:] = (1, 0.0), []
    assert [(r.rowid, r.match) for r in titles.handleInputRows(("a",), iter(rows[:1]), None)] == [(2, 1)]
    assert calls == ["get"]
