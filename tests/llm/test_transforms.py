"""Token counts, whitening and fill-in-the-middle against brute force."""

import hashlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import fill_in_middle, token_counts, whitening


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids) if text else 0


# Token counts ---------------------------------------------------------------------------------

def test_counts_are_the_librarys(spark, sf, texts, library):
    rows = token_counts.op11_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_tokens, r.n_bytes) == (library(t), len((t or "").encode()))
        assert r.over_limit == (r.n_tokens > 2048)


PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "'s", "'LL", " ", "\n", "\t\x0b", " ", "\x85", "　", "é", "é", "́", "Σ", "ΑΣ", "İ", "ß", "ǅ", "12", "x", "abc", "!!", "한", "각", "が", "が", "表", "豈", "\U0001f600", "‍", "क़", "﷽"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), max_size=14).map("".join))
@example("e" + "́" * 40)
@example("a<|endoftext|>b<|endoftext|>")
def test_any_text_counts_as_in_the_library(library, text):
    assert token_counts.Lengths("", b"").count(text) == library(text)


def test_plain_characters_need_no_normaliser():
    t = token_counts.tokenizer(None)
    plain = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not token_counts._odd.match(chr(c))]
    assert len(plain) > 20_000
    for ch in plain:
        for s in (f"A{ch}b", f"'{ch} 1{ch}!{ch}"):
            want = [x for x, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(s))]
            got = [x for p in token_counts._find.findall(s.lower()) for x, _ in t.pre_tokenizer.pre_tokenize_str(p)]
            assert got == want, hex(ord(ch))


def test_table_changes_no_count(spark, odd_docs, library):
    """With a table of many, one and no entries, on nulls, empty and very long texts."""
    want = sorted((str(r.doc_id), library(r.text)) for r in odd_docs.select("doc_id", "text").collect())
    for most in (1000, 1):
        rows = token_counts.count_tokens(odd_docs, frequent=most).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want
    pieces, lengths = token_counts.frequent_lengths(odd_docs, most=3)
    assert len(pieces.split("\n")) == len(lengths) == 3 and {"alpha", "beta", "gamma"} == set(pieces.split("\n"))
    assert [library(p) for p in pieces.split("\n")] == list(lengths)


def test_counts_of_empty_tables_and_long_words(spark, no_docs, library):
    assert token_counts.count_tokens(no_docs).collect() == []
    text = "abcdé" * 60_000 + " " + "x́" * 5000 + " tail" * 300_000
    (row,) = token_counts.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_tokens == library(text) and row.over_limit


# Whitening ------------------------------------------------------------------------------------

def plain_whitening(rows):
    """rows: (vec_id, vector). The contract in exact fractions and one eigh."""
    kept = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    means = [Fraction(s, n) for s in sums]
    centred = np.array([[float(v - m) for v, m in zip(x, means, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    out = {}
    for i, x in kept:
        c = np.array([float(v - m) for v, m in zip(x, means, strict=True)])
        out[i] = (n, sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)), c @ vectors / np.sqrt(values), values / (centred**2).sum() * n)
    return out


def same(rows, want):
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(want)
    flips = None
    for i, (n, deviation, whitened, explained) in want.items():
        got = [by[i][k + 1] for k in range(len(whitened))]
        assert len(by[i]) == len(whitened) and {(r.n, r.deviation) for r in got} == {(n, deviation)}
        assert np.allclose([r.explained for r in got], explained, rtol=1e-9) and got[0].identity_error < 1e-9
        w = np.array([r.whitened for r in got])
        flips = np.sign(w * whitened) if flips is None else flips
        assert np.allclose(w * flips, whitened, atol=1e-7)


def test_whitening_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    same(whitening.op12_whitening(spark, sf).collect(), plain_whitening([(r.vec_id, r.embedding) for r in rows]))


def test_whitening_of_hot_vectors_and_unsound_ones(spark):
    rng = np.random.default_rng(3)
    sound = [(i, rng.normal(size=5).tolist()) for i in range(200)] + [(1000 + i, [0.25] * 5) for i in range(150)]
    unsound = [(2000, None), (2001, [None] * 5), (2002, [float("nan")] * 5), (2003, [float("inf")] + [0.0] * 4), (2004, []), (2005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in sound + unsound], "vec_id long, embedding array<float>, x string")
    want = plain_whitening([(i, np.float32(v)) for i, v in sound])
    for parts in (1, 7, 400):
        got = whitening.whiten(df.repartition(parts)).collect()
        same(got, want)
    same(whitening.whiten(df.union(df.where("vec_id = 1000").withColumn("vec_id", F.lit(None).cast("long")))).where("vec_id is not null").collect(), want)


def test_whitening_has_no_direction_in_tables_without_spread(spark):
    form = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, form)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 5.0]), (2, [2.0, 4.0, 5.0]), (3, [3.0, 6.0, 5.0])], form)).collect()
    assert {(r.vec_id, r.component) for r in flat} == {(1, 1), (2, 1), (3, 1)} and abs(flat[0].explained - 1) < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 3.0]), (3, [0.0, 2.0])], form)).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(np.isfinite(r.whitened) for r in huge)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-(10**9), 10**9), min_size=3, max_size=3), min_size=1, max_size=30), st.integers(0, 30))
def test_merged_summaries_are_those_of_the_whole(rows, cut):
    x = np.array(rows, np.int64) + 1_000_000
    a, b = x[:cut], x[cut:]
    got = whitening.merged(whitening.summary(a) if len(a) else None, whitening.summary(b) if len(b) else None)
    want = whitening.summary(x)
    assert got.n == want.n and got.sums.tolist() == want.sums.tolist()
    assert np.allclose(got.scatter, want.scatter, rtol=1e-9, atol=1e-3)


# Fill in the middle ---------------------------------------------------------------------------

def plain_fim(doc_id, text, units):
    text = text or ""
    lines, n = units(text), len(units(text))
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def lines_of(text):
    import re

    return re.findall(r"[^\n]*\n|[^\n]+", text)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fill_in_middle_matches_brute_force_and_sql(spark, sf, texts):
    rows = fill_in_middle.op13_fill_in_middle(spark, sf).collect()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = con.execute(fill_in_middle.SQL)
    names = [c[0] for c in cursor.description]
    by_sql = {d["doc_id"]: d for d in (dict(zip(names, r, strict=True)) for r in cursor.fetchall())}
    assert len(rows) == len(texts) == len(by_sql)
    for r in rows:
        n, form, p, m, output = plain_fim(r.doc_id, texts[r.doc_id], lines_of)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, digest(output), digest(texts[r.doc_id] or ""))
        assert r.asDict() == by_sql[r.doc_id]


ODD = ["", "\n", "\n\n", "a", "a\n", "\na", "a\nb", "a\r\nb\r", "<P>", "x<S>y", "<M", "P>", "<", "a\n<\nS>\n", "\U0001f600\n\U0001f600é", " x", "a\x00b\n", "a b  c\n\nd\n\n\ne", None]


def test_fill_in_middle_on_odd_texts(spark, odd_docs, no_docs):
    rows = [(i, t) for i in range(40) for t in ODD] + [(None, "no\nid\n"), (5, "one\n" * 200_000)]
    made = fill_in_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = made.select("doc_id", "text", "fim.*", fill_in_middle.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    for r in kept:
        n, form, p, m, output = plain_fim(r.doc_id, r.text, lines_of)
        size = lambda x: None if x is None else len(x)
        assert (r.n, r.form, size(r.prefix), size(r.middle), r.output, r.back) == (n, form, p, m, output, r.text or "")
    assert fill_in_middle.fill_in_middle(odd_docs).columns == [*odd_docs.columns, "fim"]
    clash = odd_docs.withColumnRenamed("score", "FIM").withColumnRenamed("token", "_fim_h1")
    assert fill_in_middle.fill_in_middle(clash).columns[:-1] == clash.columns and fill_in_middle.fill_in_middle(clash).count() == 10
    assert fill_in_middle.fill_in_middle(no_docs).collect() == []
    assert {r.form for r in fill_in_middle.fill_in_middle(odd_docs, rate=0).select("fim.form").collect()} == {"plain"}


def test_units_of_every_grammar(spark):
    import re

    plain = {"lines": r"[^\n]*\n|[^\n]+", "words": r"\S*\s+|\S+", "paragraphs": r"(?s).*?\n\n+|.+", "characters": r"(?s)."}
    rows = spark.createDataFrame([(t,) for t in ODD if t is not None], "text string").select("text", *(fill_in_middle.units(F.col("text"), g).alias(g) for g in plain)).collect()
    for r in rows:
        for g, pattern in plain.items():
            assert r[g] == re.findall(pattern, r.text, re.ASCII), (g, r.text)
