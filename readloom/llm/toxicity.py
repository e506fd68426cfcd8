"""Toxicity by a weighted finite-state grammar over clauses.

A text is lower-cased and cut into clauses at sentence marks and line ends; a clause is a row of words (runs of
letters). Each word is read as one symbol: insult, threat, target, negation, reported speech or other. Four small
transducers follow one of these each and put marks on their arcs: an insult or threat within three words after a negation
is negated, one after a verb of speech in its clause is reported, an insult after a person addressed is targeted, and a
person addressed within four words after a threat completes it. They are composed into one machine by the product of
their states, and every arc's marks become a weight: a factor for each mark of an insult, an addition for a threat. The
sum of weights along a clause is the clause's score.

All weights are learnt from at most ``TRAIN_ROWS`` labelled ids outside the held-out fifth:

* insults, a lexicon of words and word beginnings, as smoothed log odds of texts where they stand neither negated nor
  reported; threats beyond the fixed list are words that mark toxic texts only where a person addressed follows;
* a mark's factor is the evidence of texts whose insults all bear it, over that of texts whose insults bear none; where
  the rows hold few or no such texts, the prior of the mark holds;
* a logistic curve over the clause scores, which each half of the rows gets from the other half's lexicon.

Words and marks are counted where the rows are; the driver sees the lexicon, a few counts and four numbers a row.

Defined cases: a null or empty text has no clause and gets the score of a text without matches; a very long text is read
whole, clause by clause; unlabelled tables give even odds; an empty ``documents`` gives an empty result; repeated rows and
ties are scored alike, each on its own; labels of a repeated id count once, the larger one; extra columns, whatever their
names, are ignored (``score_documents``) or kept (``drop_toxic``).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibration
from .common import cut, held_out, labelled

TRAIN_ROWS = 10_000
LEXICON_SIZE = 4_000
LEAST_ODDS, LEAST_TEXTS = 2.0, 3
THRESHOLD = 0.5
#: Factors of the marks and the weight of a threat before any text is seen, and how many texts' weight that has.
PRIOR = {"negated": 0.4, "reported": 0.5, "targeted": 1.5, "threat": 4.0}
PRIOR_TEXTS = 6.0

# Fixed word lists of the grammar.
NEGATION = frozenset("not never neither nor without cannot nicht nie niemals kein keine keinen jamais aucun aucune nunca jamás tampoco".split())
REPORTED = frozenset("said says wrote writes called told quoted claimed reported sagte sagt schrieb meinte nannte dit disait écrit dijo dice escribió llamó".split())
TARGET = frozenset("you your yours yourself du dich dir dein deine euch tu toi ton tes vous votre tú ti usted ustedes eres".split())
THREAT = frozenset("kill hurt destroy beat shoot stab punch strangle burn töte töten schlage erschieße tuer frapper brûler matar golpear quemar".split())

_CLAUSE = re.compile(r"[.!?;:\n\r|]+")
_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (5, 6, 7, 8)
SYMBOLS = "ITYNRO"  # insult, threat, target, negation, reported speech, other
_NONE: frozenset[str] = frozenset()


@dataclass
class Transducer:
    """``move`` maps (state, symbol) to (next state, marks)."""

    start: object
    move: dict[tuple[object, str], tuple[object, frozenset[str]]] = field(default_factory=dict)


def _within(span: int, opener: str, marked: str, name: str) -> Transducer:
    """Marks the symbols ``marked`` within ``span`` words after ``opener``; the states count the words that are left."""
    marks = frozenset([name])
    return Transducer(0, {(left, s): (span if s == opener else max(left - 1, 0), marks if left and s in marked else _NONE) for left in range(span + 1) for s in SYMBOLS})


def _after(opener: str, marked: str, name: str) -> Transducer:
    """Marks the symbols ``marked`` anywhere after ``opener``."""
    marks = frozenset([name])
    return Transducer(0, {(q, s): (int(q or s == opener), marks if q and s in marked else _NONE) for q in (0, 1) for s in SYMBOLS})


def negation(span: int = 3) -> Transducer:
    return _within(span, "N", "IY", "negated")


def reported() -> Transducer:
    return _after("R", "IY", "reported")


def target() -> Transducer:
    return _after("Y", "I", "targeted")


def threat(span: int = 4) -> Transducer:
    return _within(span, "T", "Y", "threat")


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that runs both side by side; an arc bears the marks of both."""
    out = Transducer((a.start, b.start))
    todo, seen = [out.start], {out.start}
    while todo:
        p, q = state = todo.pop()
        for s in SYMBOLS:
            (pn, pm), (qn, qm) = a.move[p, s], b.move[q, s]
            out.move[state, s] = ((pn, qn), pm | qm)
            if (pn, qn) not in seen:
                seen.add((pn, qn))
                todo.append((pn, qn))
    return out


def grammar() -> Transducer:
    """The composed machine with its states numbered from 0."""
    machine = compose(compose(negation(), reported()), compose(target(), threat()))
    number = {q: k for k, q in enumerate(dict.fromkeys([machine.start, *(q for q, _ in machine.move)]))}
    return Transducer(0, {(number[q], s): (number[n], marks) for (q, s), (n, marks) in machine.move.items()})


def _fixed(word: str) -> str:
    return "T" if word in THREAT else "Y" if word in TARGET else "N" if word in NEGATION else "R" if word in REPORTED else ""


def _traits(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def clauses(text: str) -> Iterator[list[str]]:
    for part in _CLAUSE.split(text.lower()):
        if words := _WORD.findall(part):
            yield words


def text_traits(text: str, machine: Transducer) -> tuple[set[str], set[str]]:
    """The traits of words that are neither negated nor reported, and the words that a person addressed follows closely."""
    plain: set[str] = set()
    before: set[str] = set()
    for words in clauses(text):
        if any(w in NEGATION or w in REPORTED or w in TARGET for w in words):
            state = 0
            for k, w in enumerate(words):
                symbol = _fixed(w)
                if not symbol and not machine.move[state, "I"][1] & {"negated", "reported"}:
                    plain.add(w)
                if symbol == "Y":
                    before.update(x for x in words[max(0, k - 4) : k] if not _fixed(x))
                state = machine.move[state, symbol or "O"][0]
        else:
            plain.update(words)
    return {t for w in plain if len(w) > 2 for t in _traits(w)}, {w for w in before if len(w) > 2}


class _Readings(dict):
    """Symbol and weight of words as they come up: None for a word that no transducer heeds. Emptied when large."""

    def __init__(self, lexicon: dict[str, float], threats: frozenset[str], most: int = 200_000):
        super().__init__()
        self.lexicon, self.threats, self.roots, self.most = lexicon, threats, {t[:3] for t in lexicon}, most

    def __missing__(self, word: str) -> tuple[str, float] | None:
        weight = max((self.lexicon.get(t, 0.0) for t in _traits(word)), default=0.0) if word[:3] in self.roots else 0.0
        symbol = "I" if weight else "T" if word in self.threats else _fixed(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = reading = (symbol, weight) if symbol else None
        return reading


@dataclass
class Model:
    lexicon: dict[str, float]
    threats: frozenset[str]
    factors: dict[str, float]
    curve: tuple[list[float], list[float], list[float]]

    def scorer(self) -> Callable[[str], float]:
        s = Scorer(self.lexicon, self.threats, self.factors)
        return lambda text: calibration.probability(self.curve, s.features(text))


class Scorer:
    """Clause scores of texts under one lexicon and one set of arc weights."""

    def __init__(self, lexicon: dict[str, float], threats: frozenset[str] = _NONE, factors: dict[str, float] = PRIOR):
        self.readings, self.machine = _Readings(lexicon, threats), grammar().move
        self.move = {arc: (n, math.prod(factors[m] for m in marks if m != "threat"), factors["threat"] if "threat" in marks else 0.0) for arc, (n, marks) in self.machine.items()}

    def clause(self, readings: list[tuple[str, float] | None]) -> float:
        state, score = 0, 0.0
        for reading in readings:
            symbol, weight = reading or ("O", 0.0)
            state, factor, more = self.move[state, symbol]
            score += factor * (weight + more)
        return score

    def features(self, text: str) -> list[float]:
        scores, count, read = [], 0, self.readings.__getitem__
        for words in clauses(text):
            count += len(words)
            readings = list(map(read, words))
            if any(readings) and (s := self.clause(readings)):
                scores.append(s)
        total, most = sum(scores), max(scores, default=0.0)
        return [math.log1p(total), math.log1p(most), math.log1p(100 * total / (count + 20)), math.log1p(count)]

    def marks(self, text: str) -> str:
        """The one mark that all insults and threats of a text bear: a context of insults, plain, or threat; else empty."""
        found, read = set(), self.readings.__getitem__
        for words in clauses(text):
            readings = list(map(read, words))
            if not any(readings):
                continue
            state = 0
            for reading in readings:
                symbol = reading[0] if reading else "O"
                state, marks = self.machine[state, symbol]
                if symbol == "I":
                    found.add(next((m for m in ("negated", "reported", "targeted") if m in marks), "plain"))
                elif "threat" in marks:
                    found.add(next((m for m in ("negated", "reported") if m in marks), "threat"))
        return found.pop() if len(found) == 1 else ""


def _count_traits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each trait how many texts of a fold and label have it (kind 0), or have it before a person addressed (kind 1)."""
    machine, seen = grammar(), Counter()

    def out() -> pa.RecordBatch:
        keys = list(seen)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "trait", "cell", "n"])

    for batch in batches:
        for text, cell in zip(batch.column("text").to_pylist(), batch.column("cell").to_pylist(), strict=True):
            plain, before = text_traits(text, machine)
            seen.update((0, t, cell) for t in plain)
            seen.update((1, t, cell) for t in before)
        if len(seen) > 500_000:
            yield out()
            seen.clear()
    yield out()


def learn_lexicons(rows: DataFrame) -> dict[str, tuple[dict[str, float], frozenset[str]]]:
    """Lexicon and threats of fold 0, of fold 1 and of all ``rows`` (text, cell = 2 * fold + label)."""
    totals = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    one = lambda c: F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}")
    counts = rows.select("text", "cell").mapInArrow(_count_traits, "kind int, trait string, cell int, n long").groupBy("kind", "trait").agg(*[one(c) for c in range(4)])
    counts = cut(counts.filter(f"c1 + c3 >= {LEAST_TEXTS}"))
    found = {}
    for name, cells in (("0", (0,)), ("1", (2,)), ("all", (0, 2))):
        clean, toxic = (sum(totals.get(c + label, 0) for c in cells) for label in (0, 1))
        n, m = (sum((F.col(f"c{c + label}") for c in cells), F.lit(0)) for label in (1, 0))
        odds = F.log((n + 0.5) / (toxic + 1)) - F.log((m + 0.5) / (clean + 1))
        marked = counts.select("kind", "trait", n.alias("n"), odds.alias("odds")).filter((F.col("n") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS))
        best = [marked.filter(F.col("kind") == k).orderBy(F.desc(F.col("n") * F.col("odds")), "trait").limit(LEXICON_SIZE).collect() for k in (0, 1)]
        lexicon = {r["trait"]: r["odds"] for r in best[0]}
        found[name] = lexicon, frozenset(r["trait"] for r in best[1] if not any(t in lexicon for t in _traits(r["trait"])))
    return found


def learn_factors(seen: dict[tuple[str, int], int]) -> dict[str, float]:
    """Arc weights from how many texts of a label have insults and threats of one mark only."""

    def evidence(mark: str, prior: float) -> float:
        toxic, clean = (seen.get((mark, label), 0) for label in (1, 0))
        p = 1 / (1 + math.exp(-prior))
        return math.log((toxic + PRIOR_TEXTS * p) / (clean + PRIOR_TEXTS * (1 - p)))

    plain = max(evidence("plain", 2.0), 0.5)
    found = {m: min(max(evidence(m, PRIOR[m] * plain) / plain, 0.0), 3.0) for m in ("negated", "reported", "targeted")}
    return found | {"threat": min(max(evidence("threat", PRIOR["threat"]), 0.0), 2 * PRIOR["threat"])}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = labelled(docs, labels, "toxic", TRAIN_ROWS)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(19)), F.lit(2)).cast("int")
    rows = rows.select("text", "label", (2 * fold + F.col("label")).alias("cell"), F.xxhash64("doc_id", "text").alias("key"))
    lexicons = learn_lexicons(rows)

    def over(use: Callable[[Scorer, str], object], factors: dict[str, float], kind: pa.DataType):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorers = [Scorer(*lexicons[str(1 - k)], factors) for k in (0, 1)]
            for batch in batches:
                values = [use(scorers[c // 2], t) for t, c in zip(batch.column("text").to_pylist(), batch.column("cell").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("key"), pa.array(values, kind)], ["label", "key", "value"])

        return run

    marked = rows.mapInArrow(over(Scorer.marks, PRIOR, pa.string()), "label int, key long, value string").filter("value <> ''")
    factors = learn_factors({(r["value"], r["label"]): r["n"] for r in marked.groupBy("value", "label").agg(F.count("*").alias("n")).collect()})
    known = rows.mapInArrow(over(Scorer.features, factors, pa.list_(pa.float64())), "label int, key long, value array<double>").orderBy("key").limit(TRAIN_ROWS).collect()
    x, y = np.array([r["value"] for r in known], float).reshape(-1, 4), np.array([r["label"] for r in known], float)
    return Model(*lexicons["all"], factors, calibration.fit(x, y))


def _scores(rows: DataFrame, model: Model, name: str) -> DataFrame:
    """``rows`` (some columns and text) with the score in a column ``name`` in place of the text."""
    keep = [c for c in rows.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                values = pa.array([score(t or "") for t in part.column("text").to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), values], [*keep, name])

    return rows.mapInArrow(scored, f"{fields}, `{name}` double")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return _scores(own, model, "score").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""
    import pandas as pd

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()  # one for a task
        for text in texts:
            yield text.map(score)

    scores.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.filter(F.pandas_udf(scores, "double")(F.coalesce("text", F.lit(""))) < THRESHOLD)
