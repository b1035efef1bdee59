"""Nearest by cosine in several blocks whose partitions are not merged: scores bit by bit as SQL has them, copies by id."""

import duckdb
import numpy as np
import pytest

from tidewire.operators.similarity import top_cosine


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    x[100:140], x[140:180] = x[7], x[9] * np.float32(3)
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("earlier, over", [(False, None), (True, None), (True, 0.85)])
def test_blocks_match_sql(spark, rows, earlier, over):
    con = duckdb.connect()
    con.execute("create table t(i bigint, v float[])")
    con.executemany("insert into t values (?, ?)", rows)
    want = con.execute(f"""with s as (select a.i as q, b.i as i, list_cosine_similarity(a.v::double[], b.v::double[]) as c from t a join t b on {'b.i < a.i' if earlier else 'b.i <> a.i'} where a.i % 5 = 0)
    select q, i, c, row_number() over (partition by q order by c desc, i) as n from s where c > {over or -2} qualify n <= 10""").fetchall()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        got = [tuple(r) for r in top_cosine(frame.where("vec_id % 5 = 0"), frame, 10, block=64, earlier=earlier, over=over).collect()]
    finally:
        spark.conf.unset(name)
    assert sorted(got) == sorted(want)
