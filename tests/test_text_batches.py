"""Texts reach Python in small batches."""

from tidewire.plans import running, stages


def test_texts_reach_python_in_small_batches(spark, sf, monkeypatch):
    seen, own = [], stages.Stored

    def stored(df, batch_rows=10_000):
        plan = df._jdf.queryExecution().toString()
        if "EvalPython" in plan or "MapInPandas" in plan:
            seen.append(batch_rows)
        return own(df, batch_rows)

    monkeypatch.setattr(stages, "Stored", stored)
    assert running.cli_collect(spark, sf).count() > 0
    assert seen and max(seen) <= 500
