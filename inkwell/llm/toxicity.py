"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause as a string of token classes and rewrite it: negation marks insults and threats in its
scope, reported speech marks what follows a verb of saying, target marks insults near an addressee, threat marks
threats that reach a target, and the last one weighs the marks. They are composed into one machine, which runs over
the clauses that hold a lexicon entry. A clause's weight is the machine's, for its marks, times that of its heaviest
entry; a document's score comes from the number and the weights of its matched clauses and from their marks.

The insult lexicon is a weighted set of words and word beginnings, learned from labelled rows: at most TRAIN_ROWS of
them (those of least hash), never a row whose crc32 of doc_id as text leaves 2 on division by 4. Scoring reads the
text alone.

Defined results: null and empty texts score like any text without a match. Equal texts score alike. Labels of one
doc_id that disagree count as toxic. Without any labelled row the seed lexicon and the default weights are used. An
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_or_empty

#: Labelled rows that the lexicon is learned from; patterns that MIN_TOXIC_DOCS of the toxic ones hold reach the driver.
TRAIN_ROWS = 200_000
#: Rows that the weights of the marks are fitted on.
FIT_ROWS = 20_000
MIN_TOXIC_DOCS, MIN_PRECISION, MIN_WEIGHT = 4, 0.6, 2.0
#: Lexicon weight of the words of threats, which are not learned.
THREAT_WEIGHT = 2.0
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3

#: Seed words of the classes; insults are learned besides them.
INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile dumb jerk idiota imbécil dummkopf abschaum crétin ordure".split()
THREATS = "kill hurt destroy smash stab shoot burn töten umbringen vernichten tuer détruire frapper matar destruir golpear".split()
TARGETS = "you your yours u he him his she her they them their du dich dir dein ihr euch tu toi vous te tú usted ustedes vosotros".split()
NEGATIONS = "not never isn't aren't wasn't don't nobody nicht kein keine niemals jamais aucun nunca jamás".split()
REPORTS = "said says told wrote claimed called reported quoted sagte schrieb behauptete affirme écrit dijo escribió afirmó".split()

_CLAUSE_END = re.compile("[.!?;:,\n]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


# ---- transducers ------------------------------------------------------------------------------------------------


class Transducer:
    """A deterministic weighted transducer: arcs[state][symbol] = (output, weight, next state); start state 0."""

    def __init__(self, arcs: list[dict[str, tuple[str, float, int]]]) -> None:
        self.arcs = arcs

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: this machine's output is the other's input; weights add up."""
        index, queue, arcs = {(0, 0): 0}, [(0, 0)], []
        for p, q in queue:
            row = {}
            for symbol, (middle, w1, p2) in self.arcs[p].items():
                out, w2, q2 = other.arcs[q][middle]
                if (p2, q2) not in index:
                    index[p2, q2] = len(queue)
                    queue.append((p2, q2))
                row[symbol] = (out, w1 + w2, index[p2, q2])
            arcs.append(row)
        return Transducer(arcs)

    def run(self, symbols: Iterable[str]) -> tuple[str, float]:
        state, out, total = 0, [], 0.0
        for s in symbols:
            o, w, state = self.arcs[state][s]
            out.append(o)
            total += w
        return "".join(out), total


def scoped(alphabet: str, trigger: str, span: int, marks: dict[str, str]) -> Transducer:
    """After a trigger, and for `span` tokens more, symbols are rewritten by `marks`."""
    arcs = []
    for state in range(span + 1):
        row = {}
        for s in alphabet:
            if s in trigger:
                row[s] = (s, 0.0, span)
            else:
                row[s] = (marks.get(s, s) if state else s, 0.0, max(0, state - 1))
        arcs.append(row)
    return Transducer(arcs)


def onwards(alphabet: str, trigger: str, marks: dict[str, str]) -> Transducer:
    """After a trigger, to the end of the clause, symbols are rewritten by `marks`."""
    rows = [{s: (s if k == 0 else marks.get(s, s), 0.0, 1 if s == trigger else k) for s in alphabet} for k in (0, 1)]
    return Transducer(rows)


#: Token classes: O other, I insult, H threat, T target, N negation, R report. Marks: n, m an insult, a threat in the
#: scope of a negation; q, p reported ones; A an insult near a target, B a target after an insult, K a threat that
#: reaches a target.
BASE, MARKS = "OIHTNR", "OIHTNRnmqpABK"
WEIGHTS = {"I": 1.0, "A": 1.5, "B": 0.25, "K": 1.5, "H": 0.25, "n": 0.5, "q": 0.5, "m": 0.0, "p": 0.1}


def grammar() -> Transducer:
    negation = scoped(BASE, "N", 3, {"I": "n", "H": "m"})
    report = onwards(BASE + "nm", "R", {"I": "q", "H": "p"})
    target = scoped(BASE + "nmqp", "T", 4, {"I": "A"})
    insult = scoped(BASE + "nmqpA", "IA", 3, {"T": "B"})
    threat = scoped(BASE + "nmqpAB", "H", 4, {"T": "K", "B": "K"})
    weigh = Transducer([{s: (s, WEIGHTS.get(s, 0.0), 0) for s in MARKS}])
    return negation @ report @ target @ insult @ threat @ weigh


class Scorer:
    """Lexicon, grammar and mark weights; picklable, built up once per worker."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], coef: list[float] | None = None) -> None:
        self.words, self.beginnings = words, beginnings
        self.coef = coef or [-3.0, 2.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.5]
        self._ready = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def _setup(self) -> tuple:
        if self._ready is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for k in {*self.words, *self.beginnings, *THREATS}:
                found.add_word(k, len(k))
            found.make_automaton()
            kinds = {w: c for c, ws in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("H", THREATS)) for w in ws}
            self._ready = found, kinds, grammar(), sorted({len(b) for b in self.beginnings})
        return self._ready

    def token(self, word: str) -> tuple[str, float]:
        """Class and lexicon weight of a lower-case word."""
        kinds, sizes = self._setup()[1], self._setup()[3]
        w = max([self.words.get(word, 0.0), *(self.beginnings.get(word[:k], 0.0) for k in sizes)])
        kind = "I" if w > 0 else kinds.get(word, "O")
        return kind, w or THREAT_WEIGHT * (kind == "H")

    def clauses(self, text: str) -> Iterator[tuple[str, float]]:
        """The marks and the weight of each clause that holds a lexicon entry."""
        found, _, machine, _ = self._setup()
        low = text.lower()
        ends = [m.start() for m in _CLAUSE_END.finditer(low)]
        until = -1
        for end, size in found.iter(low):
            at = end - size + 1
            if at < until or (at and low[at - 1].isalpha()):
                continue
            k = bisect.bisect_left(ends, at)
            begin, until = 1 + ends[k - 1] if k else 0, ends[k] if k < len(ends) else len(low)
            tokens = [self.token(w) for w in _WORD.findall(low, begin, until)]
            out, weight = machine.run(c for c, _ in tokens)
            lexical = max((w for c, w in tokens if c in "IH"), default=0.0)
            if lexical:
                yield out, weight * lexical

    def features(self, text: str) -> list[float]:
        marks, heaviest, total, n = Counter(), 0.0, 0.0, 0
        for out, weight in self.clauses(text):
            marks.update(out)
            heaviest, total, n = max(heaviest, weight), total + weight, n + 1
        log = math.log1p
        return [1.0, log(n), log(marks["A"]), log(marks["n"]), log(marks["q"]), log(marks["K"]), heaviest / 4, log(total) - 0.5 * log(len(text) / 2000)]

    def score(self, text: str) -> float:
        z = sum(a * b for a, b in zip(self.coef, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# ---- fit --------------------------------------------------------------------------------------------------------


def patterns(text: str) -> set[str]:
    """Words (ending in `$`) and word beginnings that a text holds."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:k] for k in PREFIXES if len(w) >= k)
    return out


def _count_patterns(wanted: frozenset[str] | None):  # noqa: ANN202
    """Documents that hold each pattern, per slice: of all patterns, or of the wanted ones for the whole task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        out = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["pattern", "n"])
        for batch in batches:
            for part in slices(batch, "_text"):
                for t in part.column("_text").to_pylist():
                    total.update(patterns(t) if wanted is None else patterns(t) & wanted)
                if wanted is None:
                    yield out(total)
                    total = Counter()
        if total:
            yield out(total)

    return count


def _featurise(scorer: Scorer):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                x = [scorer.features(t) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column("toxic")], ["x", "toxic"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 25) -> np.ndarray:
    """L2-regularised logistic regression by Newton's method; the first column is the free intercept."""
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def lexicon(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Weights (log odds) of words and beginnings that mark toxic documents; a pattern under an accepted beginning is
    left out. Seeds count as three toxic documents more."""
    words, beginnings = dict.fromkeys(INSULTS, 0.0), {}
    pos, neg = math.log(toxic + 1), math.log(clean + 1)
    weight = lambda a, b: math.log(a + 0.5) - pos - math.log(b + 0.5) + neg
    for w in words:
        a, b = counts.get(w + "$", (0, 0))
        words[w] = max(weight(a + 3, b), MIN_WEIGHT if a >= b else 0.0)
    ranked = sorted(counts.items(), key=lambda kv: (len(kv[0].rstrip("$")), kv[0]))
    for pattern, (a, b) in ranked:
        w = weight(a, b)
        if a < MIN_TOXIC_DOCS or w < MIN_WEIGHT or a < MIN_PRECISION * (a + b):
            continue
        stem = pattern.rstrip("$")
        if any(stem[:k] in beginnings for k in range(1, len(stem) + 1)):
            continue
        if pattern.endswith("$"):
            words[stem] = max(w, words.get(stem, 0.0))
        else:
            beginnings[stem] = w
    return {k: v for k, v in words.items() if v > 0}, beginnings


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Learn lexicon and mark weights. What reaches the driver: the patterns of TRAIN_ROWS rows at most
    that MIN_TOXIC_DOCS toxic ones hold, with counts, and FIT_ROWS short rows."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    train = labels.where(~held_out & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = materialize(train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS), "labels")
    # at most TRAIN_ROWS ids and labels, a few MB
    rows = docs.select("doc_id", text_or_empty().alias("_text")).join(F.broadcast(train), "doc_id")
    sizes = {int(r["toxic"] > 0): int(r["n"]) for r in train.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "pattern string, n long"
    text = rows.where("toxic > 0").select("_text")
    held = text.mapInArrow(_count_patterns(None), schema).groupBy("pattern").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TOXIC_DOCS)
    positive = {r["pattern"]: int(r["n"]) for r in held.collect()}
    counts: dict[str, tuple[int, int]] = {}
    if positive:
        against = rows.where("toxic <= 0").select("_text").mapInArrow(_count_patterns(frozenset(positive)), schema)
        negative = {r["pattern"]: int(r["n"]) for r in against.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
        counts = {k: (n, negative.get(k, 0)) for k, n in positive.items()}
    scorer = Scorer(*lexicon(counts, sizes.get(1, 0), sizes.get(0, 0)))
    some = F.broadcast(materialize(train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS), "labels"))
    sample = docs.select("doc_id", text_or_empty().alias("_text")).join(some, "doc_id").select("_text", (F.col("toxic") > 0).cast("double").alias("toxic"))
    got = sample.mapInArrow(_featurise(scorer), "x array<double>, toxic double").collect()
    y = np.array([r["toxic"] for r in got])
    if 0 < y.sum() < len(y):
        scorer.coef = logistic(np.array([r["x"] for r in got]), y).tolist()
    return scorer


def _scores(scorer: Scorer):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                s = pa.array([scorer.score(t) for t in part.column("_text").to_pylist()], pa.float64())
                rest = [c for c in part.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), s], [*rest, "score"])

    return run


def score_documents(docs: DataFrame, scorer: Scorer, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs and `score`."""
    df = docs.select(*keep, text_or_empty().alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return df.mapInArrow(_scores(scorer), f"{fields}, score double")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score_documents(docs, fit(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
