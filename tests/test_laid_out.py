"""Pages of the laid-out table: equal to those of the plain one, out of few slots."""

import glob
from pathlib import Path

import pytest

from tidewire.operators import feed, laid_out
from tidewire.plans import views


@pytest.fixture(scope="module")
def rows(spark):
    return views.articles(spark, "/root/testdata/sf0.01").cache()


@pytest.fixture(scope="module")
def laid(rows, tmp_path_factory):
    return laid_out.lay_out(rows, str(tmp_path_factory.mktemp("feed") / "t"), 50)


def keys(page):
    return [(r.article_hash, r.sort_key) for r in page.collect()]


@pytest.mark.parametrize("kind", [None, "social"])
def test_every_page_of_the_feed(rows, laid, kind):
    cursor, at = None, []
    while True:
        page, cursor = laid.page(100, kind, cursor)
        at += keys(page)
        assert len(laid.slots) <= (14 if kind else 5)
        if cursor is None:
            break
    want = feed.keyed(feed.public(rows))
    want = want.where("coalesce(content_kind, 'news') = 'social'") if kind else want
    assert at == [(r.article_hash, r.sort_key) for r in sorted(want.select("article_hash", "sort_key").collect(), key=lambda r: r.sort_key, reverse=True)]


def test_companies_and_bounds(rows, laid):
    names = [r.source_id for r in rows.groupBy("source_id").count().orderBy("count").limit(3).collect()]
    for asked in ({}, {"since": "2024-01-09", "until": "2024-01-20"}, {"kind": "news", "until": "2024-01-15"}):
        whole, cursor = [], None
        for _ in range(3):
            page, cursor = laid.page(7, asked.get("kind"), cursor, names, asked.get("since"), asked.get("until"))
            whole += [(r.article_hash, r.sort_key, r.companies[0]) for r in page.collect()]
            if cursor is None:
                break
        want = feed.of_companies(rows, names, asked.get("kind"), asked.get("since"), asked.get("until"), 21).collect()
        assert whole == [(r.article_hash, r.sort_key, r.company) for r in want]


def test_other_slots_are_not_read(rows, tmp_path):
    laid = laid_out.lay_out(rows, str(tmp_path / "t"), 50)
    _, cursor = laid.page(10)
    first = list(laid.slots)
    deep = None
    for _ in range(8):
        _, cursor = laid.page(40, None, cursor)
    before = cursor
    want, _ = laid.page(10, None, before)
    want, deep = keys(want), list(laid.slots)
    assert len(first) <= 2 and len(deep) <= 3 and not set(first) & set(deep)
    for f in glob.glob(str(tmp_path / "t" / "latest" / "slot=*" / "*.parquet")):
        if not any(f"/slot={s}/" in f for s in deep):
            Path(f).write_bytes(b"no table")
    assert keys(laid.page(10, None, before)[0]) == want


def test_an_empty_table(spark, rows, tmp_path):
    laid = laid_out.lay_out(rows.limit(0), str(tmp_path / "t"), 50)
    page, cursor = laid.page(5)
    assert page.count() == 0 and cursor is None and laid.page(5, names=["x"])[0].count() == 0
    with pytest.raises(ValueError):
        laid.page(0)
