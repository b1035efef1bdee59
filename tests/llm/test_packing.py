import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import packing


@pytest.fixture(scope="module")
def reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*(t.encode(text, add_special_tokens=False).ids if text else []), packing.END_ID]


def check(rows, texts, ids):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        want, at = ids(texts[doc]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and 0 < p.length <= packing.WINDOW and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW
    return sum(r.length for r in rows) / (packing.WINDOW * len(by_sequence))


def test_round_trip(spark, sf, texts, reference_ids):
    assert check(packing.op5_packing(spark, sf).collect(), texts, reference_ids) > 0.98


def test_ids_are_those_of_the_tokenizers_file(texts, reference_ids):
    more = ["", " ", "  x  ", "a\n\n b\t", "don't I'LL", "é\U0001f600あ 1234567", "<|endoftext|>", "\x00\x01", "x" * 3000, "  y"]
    for t in [*texts.values(), *more]:
        assert packing.token_ids(t).tolist() == reference_ids(t)


def test_added_token_has_its_id():
    assert packing.token_ids("hello <|endoftext|> world").tolist() == [31373, 220, 50256, 995, packing.END_ID]


def test_repeated_rows_are_dealt_apart(spark):
    """Rows with one id and text make no large group."""
    docs = spark.range(0, 4000).selectExpr("cast(null as long) doc_id", "repeat('some words ', 180) text")
    groups = packing.pack(packing.token_pieces(docs), group_windows=64).selectExpr("shiftright(sequence_id, 24) g").groupBy("g").count().collect()
    assert len(groups) > 5 and max(r["count"] for r in groups) < 2 * min(r["count"] for r in groups)


def test_very_long_white_space(spark, reference_ids):
    text = "a" + " " * 1_100_000 + "b <|endoftext|>"
    want = reference_ids(text)
    assert packing.token_ids(text).tolist() == want
    rows = packing.pack_documents(spark.createDataFrame([(1, text), (2, "one")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {1: len(want), 2: 2}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.select("doc_id").collect()}
    assert [r.doc_tokens for r in rows if r.doc_id == 1] == [1]
    assert len([r for r in rows if r.doc_id == 5]) == 2
    assert packing.pack_documents(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_windows_hold_every_item_once_within_capacity(sizes):
    s = np.array(sizes)
    parts = packing.windows(s, 100)
    assert sorted(i for p in parts for i in p) == list(range(len(s)))
    assert all(s[p].sum() <= 100 for p in parts)


def test_differencing_balances():
    s = np.random.default_rng(1).integers(1, 500, 900)
    sums = [s[p].sum() for p in packing.differencing(s, 100)]
    assert max(sums) - min(sums) < 60
    assert packing.differencing(np.array([8, 7, 6, 5, 4]), 2) is not None
