import re

from pyspark.sql import functions as F

from tidewire.functions import social


def plain(text):
    """The section as one lazy pattern finds it."""
    for start in (r"\n##  updates", "updates"):
        if found := re.search(rf"({start}.*?)(?=\n##[^#]|\Z)", text, re.S | re.I):
            return found[1]
    return ""


def test_sections(spark):
    texts = ["", "none", "Updates", "x\n##  UPDATES\na\n### b\n## c\n##  updates d", "an update\n##", "updates at first\n##  updates\n##", "updates\n## y\n##  updates", "\n##  updates\n##  updates\n## z", "so updates\n##\nmore"]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "n int, text string")
    got = {r.n: r.section for r in rows.select("n", social.updates_section(F.col("text")).alias("section")).collect()}
    assert got == {n: plain(t) for n, t in enumerate(texts)} | {99: None}


def test_a_section_is_worked_out_once(spark):
    """Neither a size nor a filter before the posts works the section out again; a post ends at the first mark."""
    said = ["one …more two `` `` three", "one `` `` two …more", "all of it", ""]
    page = "\n##  updates\n" + "".join(f"\n * [ ](https://www.linkedin.com/posts/p{i})\n  3d \nReport this post \n{t}" for i, t in enumerate(said)) + "\n## Other"
    pages = spark.createDataFrame([(1, page, "2024-03-10 12:00:00"), (2, "", None), (3, None, None)], "id int, page string, at string").withColumn("at", F.col("at").cast("timestamp"))
    found = social.posts(pages, "page", "at")
    assert [(r.id, r.pos, r.text) for r in found.orderBy("pos").collect()] == [(1, 0, "one"), (1, 1, "one"), (1, 2, "all of it"), (1, 3, "")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"##\[\^#\]", plan)) <= 2  # the heading's and the mention's
