"""The cascade and the set join send none of their tables through the driver, however small: no plan broadcasts one."""

import random

from tidewire.operators import cascade, similarity

FORM = "rowid long, id_hash string, title_hash string, title string, embedding array<double>, created_at double, status string"


def made(n, first, status=None):
    rng = random.Random(first)
    words = [f"w{i}" for i in range(80)]
    row = lambda i: (i, f"h{rng.randint(0, 600)}", f"t{rng.randint(0, 500)}", " ".join(rng.sample(words, rng.choice([0, 3, 5, 6]))), [rng.gauss(0, 1) for _ in range(5)], 1704067200.0 + i, status)
    return [row(first + i) for i in range(n)]


def plans_of(spark, action):
    """The names of the nodes of each plan that runs in the action."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def held():
        bus.waitUntilEmpty()
        runs = store.executionsList()
        return {runs.apply(k).executionId() for k in range(runs.size())}

    before = held()
    action()
    graphs = [store.planGraph(k).allNodes() for k in sorted(held() - before)]
    return [[nodes.apply(k).name() for k in range(nodes.size())] for nodes in graphs]


def test_a_batch_is_decided_without_a_broadcast(spark, tmp_path):
    paths = {"old": made(80, 0, "new"), "batch": made(80, 80)}
    for name, rows in paths.items():
        spark.createDataFrame(rows, FORM).write.parquet(str(tmp_path / name))
    old, batch = (spark.read.schema(FORM).parquet(str(tmp_path / name)) for name in paths)
    got = []
    plans = plans_of(spark, lambda: got.extend(cascade.resolve_batch(batch, old, old.select("id_hash", "rowid"), 1704067300.0).collect()))
    assert {r.layer for r in got} == {None, 0, 1, 2, 3}
    names = {n for nodes in plans for n in nodes}
    assert "SortMergeJoin" in names and not any("Broadcast" in n for n in names)


def test_similar_sets_meet_without_a_broadcast(spark, tmp_path):
    spark.createDataFrame(made(80, 0), FORM).write.parquet(str(tmp_path / "rows"))
    rows, got = spark.read.schema(FORM).parquet(str(tmp_path / "rows")), []
    plans = plans_of(spark, lambda: got.extend(similarity.first_similar(rows).collect()))
    names = {n for nodes in plans for n in nodes}
    assert got and "SortMergeJoin" in names and not any("Broadcast" in n for n in names)
