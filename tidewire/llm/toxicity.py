"""Toxicity by a weighted finite-state pattern grammar.

Words are tagged insult, threat, target, negation, reporting or other. Three transducers (the reach of
negation, reported speech, threats that wait for their target) and the clause's aim are composed into one
weighted transducer, and each clause runs through it. What comes out are weighted matches of a clause by
kind (plain, negated, reported, targeted, threat); a document's sums of these give its score. The insult
lexicon holds fixed words and words and word beginnings learned from labels with their log-odds as weights,
so that inflected and compounded forms match. The scores' coefficients are learned on other labelled rows
than the lexicon.

Only rows whose crc32(doc_id as text) mod 5 is not 0 teach; at most TRAIN_DOCS of them, those least by
a hash of the id. The only input of a score is the text. Nulls are empty texts. Without toxic labels
the fixed words and default coefficients score. Of labelled near copies the least id teaches, so the same
rows give the same scores. Rows are scored one by one, whole and however long; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import cut_lineage, over_texts, ship, shingles, sliced, table, word_hashes

TRAIN_DOCS = 12_000
#: Strength of the default coefficients, in rows: a handful of labels moves them little.
RIDGE = 10.0
#: Lengths of word beginnings that the lexicon may hold.
BEGINNINGS = (4, 5, 6)

#: Fixed words of the grammar's other classes, and insults known without labels.
INSULTS = "idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting trash clown clowns imbecile dumbass bastard vermin parasite idiota estúpido imbécil basura idiote débile ordure crétin abruti trottel dummkopf abschaum vollidiot"
THREATS = "kill hurt destroy beat shoot stab punch burn hang crush strangle töten umbringen schlagen tuer frapper matar golpear"
TARGETS = "you your yours u him her them they he she everyone people du dich dir ihr euch sie er tu te toi vous ils elle usted ustedes ti ellos"
NEGATIONS = "not never no nobody isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás tampoco"
REPORTS = "said says wrote writes quoted quotes called claims claimed accused reported allegedly according sagte sagt schrieb nannte laut déclaré écrit selon appelé dijo dice escribió según llamó"

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
KINDS = ("plain", "negated", "reported", "targeted", "threat")

#: state, class -> next state. Negation reaches three words; missing: stay (reporting lasts to the clause's end).
NEGATION_ARCS = {(s, c): (3 if c == NEGATION else max(s - 1, 0)) for s in range(4) for c in range(6)}
REPORT_ARCS = {(s, c): int(s or c == REPORT) for s in range(2) for c in range(6)}
#: A threat waits up to four words for its target: state is the words left.
THREAT_ARCS = {(s, c): (4 if c == THREAT else 0 if c == TARGET else max(s - 1, 0)) for s in range(5) for c in range(6)}

#: Weights that arcs give what they put out: to an insult times its own, to a threat that meets its target alone.
INSULT_WEIGHT, THREAT_WEIGHT = 1.0, 2.0


def composed() -> list[list[tuple[int, str | None, float]]]:
    """The three transducers and the clause's aim as one weighted transducer: state, class -> next state, kind put out, weight.

    The first states are the starts of clauses without and with a target.
    """
    states = [(n, r, t, a) for n in range(4) for r in range(2) for t in range(5) for a in (False, True)]
    number = {s: i for i, s in enumerate(states)}
    out = []
    for n, r, t, aimed in states:
        arcs = []
        for c in range(6):
            after = number[NEGATION_ARCS[n, c], REPORT_ARCS[r, c], THREAT_ARCS[t, c], aimed]
            if c == INSULT:
                arcs.append((after, "negated" if n else "reported" if r else "targeted" if aimed else "plain", INSULT_WEIGHT))
            elif c == TARGET and t and not n and not r:
                arcs.append((after, "threat", THREAT_WEIGHT))
            else:
                arcs.append((after, None, 0.0))
        out.append(arcs)
    return out


ARCS = composed()

_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSES = re.compile(r"[.!?;:\n]+")


class Lexicon:
    """Weights of whole words and of word beginnings; classes of fixed words."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words = {w: 2.0 for w in INSULTS.split()} | words
        self.beginnings = beginnings
        self.classes = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws.split()}
        self.lengths = sorted({len(b) for b in beginnings})
        self.threats = frozenset(THREATS.split())

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in self.lengths:
            found = max(found, self.beginnings.get(word[:n], 0.0))
        return found

    def matches(self, text: str | None) -> tuple[list[float], list[tuple[str, str, float]]]:
        """Sums by kind with the greatest weight and the sum for each root of the word count; and the matches: kind, word, weight."""
        low = (text or "").lower()
        words = _WORDS.findall(low)
        known = {w: x for w in set(words) if (x := self.weight(w)) > 0}
        threats = not self.threats.isdisjoint(words)
        if not known and not threats:
            return [0.0] * (len(KINDS) + 2), []
        sums, greatest, out = dict.fromkeys(KINDS, 0.0), 0.0, []
        for clause in _CLAUSES.split(low):
            tokens = _WORDS.findall(clause)
            if not any(w in known or w in self.threats for w in tokens):
                continue
            tags = [INSULT if w in known else self.classes.get(w, OTHER) for w in tokens]
            state = int(TARGET in tags)
            for word, tag in zip(tokens, tags, strict=True):
                state, kind, weight = ARCS[state][tag]
                if kind:
                    weight *= known[word] if tag == INSULT else 1.0
                    sums[kind] += weight
                    out.append((kind, word, weight))
                    if tag == INSULT:
                        greatest = max(greatest, known[word])
        total = sum(sums.values())
        return [*(float(np.log1p(sums[k])) for k in KINDS), greatest, total / max(1.0, len(words)) ** 0.5], out


class Grammar:
    """The lexicon with logistic coefficients over a document's matches."""

    #: Before any labels: matched clauses add up, negated and reported ones hardly.
    DEFAULT = np.array([2.0, 0.3, 0.5, 2.2, 2.0, 0.5, 0.5, -3.0])

    def __init__(self, lexicon: Lexicon, x: np.ndarray | None = None, y: np.ndarray | None = None):
        self.lexicon, self.weights = lexicon, self.DEFAULT.copy()
        if x is None or not len(y) or not 0 < y.sum() < len(y):
            return
        a = np.hstack([x, np.ones((len(x), 1))])
        ridge = RIDGE * np.eye(a.shape[1])  # towards the default coefficients, which a few rows move little
        w = self.DEFAULT.copy()

        def loss(v: np.ndarray) -> float:
            return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ v)).sum() + RIDGE * (v - self.DEFAULT) @ (v - self.DEFAULT) / 2)

        for _ in range(100):  # Newton steps of ridge logistic regression, halved until they go down: the loss is convex
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ (w - self.DEFAULT))
            size, now = 1.0, loss(w)
            while size > 1e-6 and loss(w + size * step) > now:
                size /= 2
            w = w + size * step
            if size * abs(step).max() < 1e-6:
                break
        self.weights = w

    def score(self, text: str | None) -> float:
        x, _ = self.lexicon.matches(text)
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights[:-1], x) + self.weights[-1], -30, 30))))


def _marks(word: str) -> list[str]:
    """A word ends in a stop; a beginning does not."""
    return [word + ".", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def remainder(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def _counts(docs: DataFrame, toxic: int, wanted: frozenset[str] | None) -> DataFrame:
    """Rows (mark, n): in how many of these documents each mark stands, those wanted only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            count: Counter = Counter()
            for text in batch.column(0).to_pylist():
                marks = {m for w in set(_WORDS.findall((text or "").lower())) for m in _marks(w)}
                count.update(marks if wanted is None else marks & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["mark", "n"])

    return docs.where(F.col("toxic") == toxic).select("text").mapInArrow(run, "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n"))


def fit_grammar(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Grammar:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1)."""
    ship(docs.sparkSession)
    lot = labels.where(F.col("toxic").isin(0, 1) & (remainder("doc_id") != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lot = lot.orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").limit(train_docs)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least hash of five-word shingles: near copies mostly share it, and one of them teaches."""
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            least = [int(s[0].astype(np.int64)) if len(s := shingles(word_hashes(t or ""), 5)) else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["doc_id", "text", "toxic", "least"])

    taught = docs.select("doc_id", "text").join(F.broadcast(lot), "doc_id").select("doc_id", "text", F.col("toxic").cast("long").alias("toxic"))
    taught = taught.mapInArrow(look, "doc_id long, text string, toxic long, least long")
    firsts = taught.groupBy("least", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("row")).select("row.*", "toxic", "least")
    taught = cut_lineage(firsts.withColumn("half", F.pmod(F.xxhash64("least"), F.lit(2))))
    first, second = taught.where("half = 0"), taught.where("half = 1")
    sizes = {r.toxic: r.n for r in first.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    least = max(3, round(0.015 * toxic))
    marks = {r.mark: r.n for r in _counts(first, 1, None).where(F.col("n") >= least).collect()}
    against = {r.mark: r.n for r in _counts(first, 0, frozenset(marks)).collect()} if marks else {}
    odds = {}
    for mark, n in marks.items():
        other = against.get(mark, 0)
        value = np.log((n + 0.5) / (toxic + 1)) - np.log((other + 0.5) / (clean + 1))
        if value > 2 and n >= 4 * other:
            odds[mark] = float(value)
    kept = {}
    for mark in sorted(odds, key=lambda m: (len(m), m)):  # a longer form says nothing new where its beginning says as much
        stems = [mark[:n] for n in BEGINNINGS if n < len(mark.rstrip(".")) or (mark.endswith(".") and n <= len(mark) - 1)]
        if not any(s in kept and kept[s] >= odds[mark] - 0.7 for s in stems):
            kept[mark] = odds[mark]
    lexicon = Lexicon({m[:-1]: x for m, x in kept.items() if m.endswith(".")}, {m: x for m, x in kept.items() if not m.endswith(".")})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [lexicon.matches(t)[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    rows = sorted(tuple(r) for r in second.select("text", "toxic").mapInArrow(measure, "x array<double>, toxic long").collect())
    return Grammar(lexicon, np.array([r[0] for r in rows]).reshape(-1, len(KINDS) + 2), np.array([r[1] for r in rows], float))


def score_toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, score and predicted."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = [grammar.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with the same columns."""
    ship(docs.sparkSession)
    return docs.where(over_texts(lambda texts: [grammar.score(t) < 0.5 for t in texts], "boolean")(text_col))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = fit_grammar(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, grammar)
    return scored.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", "predicted")
