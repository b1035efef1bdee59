"""The pipeline against brute force on a small fixture, and its stages on odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_ngram_join import plain_components, plain_sets
from tests.llm.test_packing import check
from tests.llm.test_scans import plain_pii
from tests.llm.test_search import plain_leaks
from tidewire.llm import packing, pii, toxicity


def test_run_matches_brute_force(spark, sf, texts):
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grammar = toxicity.fit_grammar(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = {k: t for k, t in texts.items() if grammar.score(t) < 0.5}
    assert 0 < len(left) < len(texts)
    component = plain_components({k: k for k in left}, plain_sets(left))
    left = {k: t for k, t in left.items() if component[k] == k}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {r.doc_id for r in rows}
    assert found <= set(left)
    gone = set(left) - found
    by_size = sorted(gone, key=lambda k: len(left[k]))
    assert gone and all(plain_leaks(left[k], items) for k in by_size[:3])
    assert not any(plain_leaks(left[k], items) for k in sorted(found, key=lambda k: len(left[k]))[:8])
    left = {k: left[k] for k in found}
    frame = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    selector = pii.fit_selector(frame.orderBy("doc_id"))
    clean = {k: pii.redact(t, [(a, b, kind) for kind, a, b in pii.spans_of(t, selector)[1]]) for k, t in left.items()}
    assert not any(any(plain_pii(t).values()) for t in clean.values())
    assert check(rows, clean, lambda t: packing.token_ids(t).tolist()) > 0.97


def test_stages_keep_columns_and_take_odd_rows(spark, sf, odd_docs, no_docs):
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    for frame in (odd_docs, odd_docs.select(*base), no_docs):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == frame.columns, name
        assert docs.where(F.col("n_chars") != F.length("text")).count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= min(1, frame.count())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "pii", "packing"]
