"""Marks, look-ups, and the finish reason of blank answers."""

from tidewire.operators import store
from tidewire.sources import readers

FORM = "article_hash string, title string, raw_link string, title_hash string, summary_status string, published_at string, collected_at string, extra string"
ROWS = [
    ("a", "A", "l1", "t1", "pending", "2024-01-01", "2024-01-01T00:00:00Z", "x"),
    ("b", "B", "l1", "t1", "irrelevant", "2024-01-05", "2024-01-05T00:00:00Z", None),
    ("c", "C", "", "t1", None, "2024-01-03", "2024-01-03T00:00:00Z", None),
    ("d", "D", None, "t2", "failed", "", "2024-01-02T00:00:00Z", None),
]


def test_marks(spark):
    articles = spark.createDataFrame(ROWS, FORM)
    marks = spark.createDataFrame([("a", "irrelevant", None), ("a", "failed", "late"), ("c", "failed", "boom"), ("d", "failed", None), ("zz", "failed", "x"), ("b", "other", "x")], "article_hash string, status string, error string")
    got = {r.article_hash: (r.summary_status, r.extra, r.version) for r in store.marked(articles, marks, 3).collect()}
    assert got == {"a": ("irrelevant", "x", 3), "c": ("failed", "boom", 3), "d": ("failed", "", 3)}
    assert store.marked(articles.drop("extra"), marks, 3).count() == 3


def test_look_ups(spark):
    articles = spark.createDataFrame(ROWS, FORM)
    one = lambda df: [r.article_hash for r in df.collect()]
    assert one(store.found_by_hash(articles, "a")) == ["a"] and one(store.found_by_hash(articles, "a", "a")) == one(store.found_by_hash(articles, "b")) == one(store.found_by_hash(articles, "zz")) == []
    assert one(store.found_by_raw_link(articles, "l1")) == ["a"] and one(store.found_by_raw_link(articles, "")) == []
    assert one(store.found_by_title_hash(articles, "t1", "2024-01-01")) == ["c"] and one(store.found_by_title_hash(articles, "t1", "2024-01-01", "c")) == ["a"]
    assert one(store.found_by_title_hash(articles, "t1", "2024-01-04")) == []


def test_finish_reasons(spark):
    articles = spark.createDataFrame([("a", "fine"), ("b", "blank"), ("c", "cut"), ("d", "plain blank")], "article_hash string, content string")
    said = {"fine": ("an answer", "stop"), "blank": (" \n", None), "cut": (None, "length"), "plain blank": ""}
    got = {r.article_hash: (r.raw, r.error) for r in readers.summarized(articles, said.__getitem__).collect()}
    assert got == {"a": ("an answer", None), "b": (None, "empty response (finish_reason=unknown)"), "c": (None, "empty response (finish_reason=length)"), "d": (None, "empty answer")}
