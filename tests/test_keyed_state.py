"""Expiring keyed state over many triggers, against the batch twins."""

import random


from tidewire.operators.anchors import first_for_a_while
from tidewire.streaming import jobs, keyed_state


def stream_of(own, folder, rows, form, parts):
    """Rows in files, one to a trigger."""
    for k in range(parts):
        own.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], form).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03}")
    return own.readStream.schema(own.createDataFrame([], form).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def run(own, stream, tmp_path):
    out = []
    query = stream.writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return out, [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def test_breaker_is_its_batch_twin_and_forgets(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"h{rng.randint(0, 4)}", i, 1.7e9 + 40.0 * i, rng.choice([200, 200, 403, 500, 500]), rng.choice([None, 5.0, 500.0])) for i in range(240)]
    rows += [("quiet", 1000, rows[-1][2] + 1, 500, None), ("quiet", 1001, rows[-1][2] + 2, 500, None), ("h0", 1002, rows[-1][2] + 90_000, 200, None), ("quiet", 1003, rows[-1][2] + 100_000, 500, None)]
    own = keyed_state.session_with_state(spark)
    form = "host string, id long, at double, status int, retry_after double"
    got, held = run(own, keyed_state.breaker(stream_of(own, str(tmp_path / "in"), rows, form, 8)), tmp_path)
    twin = jobs.breaker_batch(spark.createDataFrame([r for r in rows if r[1] != 1003], form))
    want = {r.id: (r.failures, r.blocked_until) for r in twin.collect()} | {1003: (1, 0.0)}
    assert {r.id: (r.failures, r.blocked_until) for r in got} == want
    assert "spark.sql.streaming.stateStore.providerClass" not in spark.conf.getAll


def test_titles_of_the_last_hours(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"t{rng.choice([0, 0, 0, *range(20)])}", 1.7e9 + 1800.0 * i) for i in range(200)]
    rows.append((500, "end", 1.7e9 + 1800.0 * 200 + 10_000_000))
    rows.append((501, "end of all", 1.7e9 + 1800.0 * 200 + 20_000_000))
    own = keyed_state.session_with_state(spark)
    got, held = run(own, keyed_state.first_titles(stream_of(own, str(tmp_path / "in"), rows, "rowid long, title_hash string, created_at double", 10), 10), tmp_path)
    twin = first_for_a_while(spark.createDataFrame([(t, int(at), f"{i:06}") for i, t, at in rows], "key string, at long, id string"), 36_000)
    want = {int(r.id): None if r.match is None else int(r.match) for r in twin.collect()}
    assert {r.rowid: r.match for r in got} == want and {r.rowid: r.status for r in got} == {i: "new" if m is None else "dupe" for i, m in want.items()}
    assert max(held) >= 15 and held[-1] <= 6  # each title has a row of state and one of its timer
