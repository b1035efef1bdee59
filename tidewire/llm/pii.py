"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans; boosted trees give each candidate a margin from
its format and context; a Platt-calibrated threshold for each kind selects. Base detections (email,
ip, card, phone) always stay: they are rules, and also what teaches the trees. The trees never see
the validators (checksums, part ranges), only shapes and surroundings, so that they carry over to
forms without one.

The trees are fitted on a bounded sample: all documents are scanned for candidates, and of each kind
about SAMPLE_KIND are drawn by a hash of their id, place and text, so a rare kind is in it whole. A hash
of the id halves the sample for fitting and calibration. A kind without a base rule that is not in the
calibration half gets the threshold of all kinds together. Where a kind has too few right candidates to learn from (FEW in
each half), or no threshold is right often enough, its validator selects as well, so no kind is dropped
whole. Every whole text is then scanned, in time that grows as its length. Nulls are empty texts. Rows are
scanned one by one, so repeated rows give repeated results; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.boosting import BoostedTrees, platt
from tidewire.llm.common import over_texts, ship, sliced, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "mail_words", "local_phone")
SAMPLE_KIND, FEW = 5000, 20
#: Selected candidates of a kind are to be right this often on the calibration half of the sample.
PRECISION = 0.9

_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL, _DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MORE = {
    "ssn": re.compile(r"(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])", re.A),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A),
    # runs are taken whole and from their beginning, so that a long one is read once
    "mail_words": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]++)+", re.A | re.I),
    "local_phone": re.compile(r"(?<![\w+.-])\(?\d{2,4}\)?[ .-]\d{3}[ .-]\d{3,4}(?![\w-])", re.A),
}

_BRACKETED = re.compile(r"(?i)[\[({] ?at ?[\])}]")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return not (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from the at signs: linear in the text."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            low = m.end()
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {k: [] for k in BASE}
    out["email"] = list(emails(text))
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0]) if m.end() - m.start() > 15 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15] if "+" in text else []
    return out


def _valid(kind: str, s: str) -> bool:
    """Weak labels for the kinds without a base rule."""
    if kind == "ssn":
        a, b, c = s[:3], s[4:6], s[7:]
        return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"
    if kind == "iban":
        flat = s.replace(" ", "")
        return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    if kind == "local_phone":
        digits = re.sub(r"\D", "", s)
        return len(digits) == 10 and digits[0] not in "01" and digits[3] not in "01"
    last = re.split(r"[^A-Za-z0-9-]+", s)[-1]  # of a mail in words: a top-level domain has letters, two at least
    return len(last) >= 2 and last.isalpha()


_DIGIT = re.compile(r"[0-9]")
_RUNS = re.compile(r"[0-9]+")
_CUES = re.compile(r"(?i)mail|contact|call|phone|tel|fax|mobile|card|visa|iban|account|acct|ssn|social|address|\bip\b|host|server|from|\bto\b")
_NOISE = re.compile(r"(?i)version|release|build|\bid\b|isbn|doi|order|page|figure|table|=|#|\bv$")
FEATURES = 15


def features(text: str, start: int, stop: int) -> list[float]:
    s, before, after = text[start:stop], text[max(0, start - 32) : start], text[stop : stop + 16]
    runs = [len(r) for r in _RUNS.findall(s)] or [0]
    digits = sum(runs)
    letters = sum(c.isalpha() for c in s)
    return [
        len(s), digits, letters, len(s) - digits - letters, len(runs), max(runs), min(runs), s.count("."), s.count(" ") + s.count("-"),
        float(s[:1] == "+"), float("@" in s), float(bool(before[-1:].strip()) and before[-1:].isalnum()), float(after[:1].isalnum()),
        float(len(_CUES.findall(before))), float(len(_NOISE.findall(before)) + len(_DIGIT.findall(after)) / 4),
    ]


def candidates(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int, bool]]]:
    """Base spans, and all candidates: kind, start, stop, weak label."""
    if not _DIGIT.search(text) and "@" not in text and not _BRACKETED.search(text):
        return {k: [] for k in BASE}, []
    base = base_spans(text)
    out = [(k, a, b, True) for k in BASE for a, b in base[k]]
    known = set(out)
    # wider forms of the base kinds: what failed validation teaches the trees what does not count
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, *m.span(), False) for m in pattern.finditer(text) if m.end() - m.start() >= 7 and (kind, *m.span(), True) not in known]
    taken = _union(span for k in BASE for span in base[k])
    for kind, pattern in _MORE.items():
        if kind == "mail_words" and not _BRACKETED.search(text):
            continue
        out += [(kind, *m.span(), _valid(kind, m[0])) for m in pattern.finditer(text) if not _overlaps(*taken, *m.span())]
    return base, out


def _union(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and stops of the stretches that the spans cover, rising."""
    starts, stops = [], []
    for a, b in sorted(spans):
        if stops and a <= stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            starts.append(a)
            stops.append(b)
    return starts, stops


def _overlaps(starts: list[int], stops: list[int], start: int, stop: int) -> bool:
    i = bisect_right(stops, start)
    return i < len(starts) and starts[i] < stop


class Selector:
    """Trees, calibration and a threshold for each kind."""

    def __init__(self, rows: list[tuple[str, list[float], bool, bool]]):
        """rows: kind, features, weak label, whether the row is for calibration."""
        x = np.array([r[1] for r in rows], float).reshape(-1, FEATURES)
        y, late, kind = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], bool), np.array([r[0] for r in rows])
        self.trees = BoostedTrees().fit(x[~late], y[~late])
        self.a, self.b = platt(self.trees.margin(x[late]), y[late])
        p = self.score(x)
        self.least, self.trusted = {}, set()

        def least(mine: np.ndarray) -> float:
            order = np.argsort(-p[mine])
            hits = np.cumsum(y[mine][order])
            right = hits / (np.arange(len(hits)) + 1) >= PRECISION
            return max(float(p[mine][order][np.flatnonzero(right)[-1]]), 0.5) if right.any() else 2.0  # nothing to learn from: none

        pooled = least(late)
        for k in KINDS:
            mine = late & (kind == k)
            self.least[k] = least(mine) if mine.any() else 2.0 if k in BASE else pooled  # base kinds have their rules
            if self.least[k] > 1 or min(y[mine].sum(), y[~late & (kind == k)].sum()) < FEW:
                self.trusted.add(k)

    def selects(self, kind: str, valid: bool, p: float) -> bool:
        return p >= self.least[kind] or valid and kind in self.trusted

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.trees.margin(x) + self.b, -30, 30)))


def _hash(*parts: object) -> int:
    """63 bits."""
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest()) >> 1


def fit_selector(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_kind: int = SAMPLE_KIND) -> Selector:
    """Fits on about `sample_kind` candidates of each kind."""
    ship(docs.sparkSession)
    lot = docs.where(F.col(text_col).rlike(r"[0-9@]|[\[({] ?[aA][tT] ?[\])}]")).select(id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = dict.fromkeys(KINDS, 0)
        for batch in sliced(batches):
            for t in batch.column(1).to_pylist():
                for k, *_ in candidates(t)[1]:
                    n[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["kind", "n"])

    counts = lot.mapInArrow(count, "kind string, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect()
    bounds = {r.kind: min(1 << 63, (sample_kind << 63) // max(1, r.n)) for r in counts}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                late = _hash(d) % 2 == 1
                for k, a, b, y in candidates(t)[1]:
                    h = _hash(k, d, a, t[max(0, a - 32) : b + 16])
                    if h < bounds[k]:
                        rows.append((h, k, features(t, a, b), y, late))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.list_(pa.float64()), pa.bool_(), pa.bool_()), strict=True)], names=["h", "kind", "x", "y", "late"])

    # repeated rows are drawn together, and count once
    rows = lot.mapInArrow(draw, "h long, kind string, x array<double>, y boolean, late boolean").dropDuplicates(["h", "kind"]).collect() if bounds else []
    return Selector([(r.kind, r.x, r.y, r.late) for r in sorted(rows)])


def spans_of(text: str | None, selector: Selector) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans, and all selected spans by kind as listed, then start."""
    text = text or ""
    base, found = candidates(text)
    out = [(k, a, b) for k in BASE for a, b in base[k]]
    known = set(out)
    more = [c for c in found if c[:3] not in known]
    if more:
        p = selector.score(np.array([features(text, a, b) for _, a, b, _ in more], float))
        out += sorted({c[:3] for c, x in zip(more, p, strict=True) if selector.selects(c[0], c[3], x)})
    return base, sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, selector: Selector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts of base spans, their digest, and all selected spans."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts, shas, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base, all_spans = spans_of(text, selector)
                counts.append([len(base[k]) for k in BASE])
                shas.append(hashlib.sha256(_joined([(k, a, b) for k in BASE for a, b in base[k]]).encode()).hexdigest())
                spans.append(_joined(all_spans))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=[id_col, *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string")


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """Spans replaced by their kind in angle brackets; of overlapping ones the first, and of those that start together the longest."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, stop, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, selector: Selector, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with selected spans redacted; a column of the name size_col, in these very letters, gets the new text's length."""
    ship(docs.sparkSession)
    clean = over_texts(lambda texts: [redact(t, [(a, b, k) for k, a, b in spans_of(t, selector)[1]]) for t in texts], "string")
    out = docs.withColumn(text_col, clean(text_col))
    return out.withColumn(size_col, F.length(text_col).cast("long")) if size_col in docs.columns else out


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, fit_selector(docs))
