"""Operator 10: toxicity by Levenshtein automata over a learned lexicon trie, with context windows.

Fit (driver, bounded): of the labelled rows whose crc32(doc_id as text) mod 5 is not 0, SAMPLE of each label, in hash order, as
long as their texts together stay within SAMPLE_BYTES a label; a text of more than a hundredth of that is not fitted on.
Words, and beginnings of words, that toxic texts hold far more often than clean ones are the lexicon; a logistic model over
the features below weighs them.  Beginnings match exactly, whole words of FUZZY_LEN letters or more also within one edit, those with a
learned beginning too.

Score (executors, no shuffle): the lexicon trie intersected with the Levenshtein automaton of distance 1 is made
deterministic on the fly and every word of the whole text is read by it; most words leave it after a few letters.  Matches in
a window with quotation marks or reporting words count as quoted, the others as abuse; the model weighs both.

Null and empty texts score as a text without matches.  Labels, lang, source and doc_id are never inputs of a score.  Null
labels or doc_ids take no part in fitting; a null doc_id is not held out.  Repeated rows give repeated rows.  An empty
documents table gives an empty one; without toxic or without clean labels every score is the share of label 1 (0.0 if none).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .sparkutil import prepare

#: Texts of each label that are fitted on, at most.
SAMPLE = 3_000
#: Bytes of the texts of each label that are fitted on, at most.
SAMPLE_BYTES = 64_000_000
#: Words on each side that a context window has.
WINDOW = 6
FUZZY_LEN = 5
#: A word starts with a letter and may hold digits, and between letters or digits the signs that stand for letters in disguise.
WORD = re.compile(r"[^\W\d_][^\W_]*(?:[@$*!][^\W_]+)*")
#: Marks and words that set a passage apart as someone else's.
MARKS = frozenset("\"'“”„‘’«»")
REPORT = frozenset(["said", "says", "wrote", "quoted", "called", "reported", "claimed", "tweeted", "posted", "sagte", "schrieb", "dijo", "escribió", "dit", "écrit"])


class Lexicon:
    """The trie of terms (whole words; with a star, beginnings) and its deterministic product with one edit."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.weight: dict[str, float] = {**words, **{s + "*": w for s, w in stems.items()}}
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        for term, ends in [*((w, self.ends) for w in words), *((s, self.stem) for s in stems)]:
            at = 0
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.stem.append(None)
                at = self.next[at][c]
            ends[at] = term
        self.fuzzy = {t for t in words if len(t) >= FUZZY_LEN}
        self.start = self._close({(0, 0)})
        self.steps: dict[frozenset, dict[str, frozenset]] = {}
        self.seen: dict[str, tuple[str, int] | None] = {}

    def _close(self, states: set[tuple[int, int]]) -> frozenset:
        """With one edit left a letter of a term may be missing in the word."""
        return frozenset(states | {(n, 1) for at, e in states if e == 0 for n in self.next[at].values()})

    def _step(self, states: frozenset, c: str) -> frozenset:
        known = self.steps.setdefault(states, {})
        if c not in known:
            out = set()
            for at, e in states:
                if c in self.next[at]:
                    out.add((self.next[at][c], e))
                if e == 0:
                    out.add((at, 1))
                    out.update((n, 1) for x, n in self.next[at].items() if x != c)
            if len(self.steps) > 200_000:
                self.steps.clear()
                known = self.steps.setdefault(states, {})
            known[c] = self._close(out)
        return known[c]

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the heaviest term of the fewest edits that matches a lower-case word, or None."""
        if word in self.seen:
            return self.seen[word]
        states, best, exact = self.start, None, 0
        for c in word:
            exact = self.next[exact].get(c) if exact is not None else None
            if exact is not None and self.stem[exact] is not None:
                best = self._better(best, (self.stem[exact] + "*", 0))
            states = self._step(states, c)
            if not states:
                break
        else:
            for at, e in states:
                term = self.ends[at]
                if term is not None and (e == 0 or term in self.fuzzy):
                    best = self._better(best, (term, 0 if term == word else 1))
        if len(self.seen) > 300_000:
            self.seen.clear()
        self.seen[word] = best
        return best

    def _better(self, a, b):
        return b if a is None or (b[1], -self.weight[b[0]], b[0]) < (a[1], -self.weight[a[0]], a[0]) else a

    def features(self, text: str) -> list[float]:
        """Exact and fuzzy matches as abuse, matches as quotation, their weight, and their share of the words."""
        low = text.lower()
        words = WORD.findall(low)
        seen, match = self.seen, self.match
        found = [(i, m) for i, m in ((i, seen[w] if w in seen else match(w)) for i, w in enumerate(words)) if m]
        if not found:
            return [0.0] * 5
        spans, quoted = None, 0
        exact = fuzzy = 0
        top = 0.0
        for i, (term, edits) in found:
            near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            set_apart = not REPORT.isdisjoint(near)
            if not set_apart:
                spans = spans or [m.span() for m in WORD.finditer(low)]
                a, b = spans[i]
                left, right = low[spans[max(0, i - WINDOW)][0] : a], low[b : spans[min(len(words) - 1, i + WINDOW)][1] + 1]
                set_apart = not MARKS.isdisjoint(left) and not MARKS.isdisjoint(right)
            quoted += set_apart
            exact += not set_apart and edits == 0
            fuzzy += not set_apart and edits > 0
            top = max(top, self.weight[term] * (1.0 if edits == 0 else 0.5))
        return [np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), top, 100.0 * len(found) / len(words)]


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    coef: list[float]
    bias: float

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.stems)


def learn_terms(toxic: list[str], clean: list[str], least: int = 3, ratio: float = 8.0) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings (4 to 7 letters) that toxic texts hold ratio times as often, smoothed, with their log ratio."""

    def counts(texts, cut):
        c: Counter = Counter()
        for t in texts:
            words = set(WORD.findall(t.lower()))
            c.update(words if cut is None else {w[:cut] for w in words if len(w) >= cut})
        return c

    def strong(cut):
        halves = [(counts(toxic[h::2], cut), counts(clean[h::2], cut), len(toxic[h::2]), len(clean[h::2])) for h in (0, 1)]
        out = {}
        for w in halves[0][0].keys() & halves[1][0].keys():
            lifts = [np.log((a[w] + 0.5) / (na + 1)) - np.log((b[w] + 0.5) / (nb + 1)) for a, b, na, nb in halves]
            # either half must show it: what one half shows by chance the other does not
            if len(w) > 2 and min(lifts) >= np.log(ratio) and min(a[w] for a, _, _, _ in halves) >= least and sum(b[w] for _, b, _, _ in halves) * ratio <= sum(a[w] for a, _, _, _ in halves):
                out[w] = float(np.mean(lifts))
        return out

    stems: dict[str, float] = {}
    for cut in (4, 5, 6, 7):
        for s, w in strong(cut).items():
            if not any(s[:k] in stems for k in range(4, cut)):
                stems[s] = w
    # a beginning only adds exact matches: the words that it covers stay, for their misspellings
    return strong(None), stems


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.05) -> tuple[list[float], float]:
    """Newton steps of a ridge logistic regression."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    pen = np.full(a.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pen) + 1e-9 * np.eye(len(w)), a.T @ (p - y) + pen * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w[:-1]], float(w[-1])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    lab = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col("toxic").cast("int").alias("y")).where("lid is not null and y in (0, 1)").groupBy("lid").agg(F.max("y").alias("y"))
    lab = lab.where(~held_out(F.col("lid")))
    h = F.xxhash64("lid")
    picked = lab.where("y = 1").orderBy(h, "lid").limit(sample).union(lab.where("y = 0").orderBy(h, "lid").limit(sample))
    have = docs.select(F.col("doc_id").cast("long").alias("lid"), "text").join(F.broadcast(picked), "lid").where("text is not null")
    # of an id with several texts the one with the smallest hash, so that a rerun fits the same model
    one = have.select("lid", "y", F.col("text").cast("string").alias("text")).groupBy("lid").agg(F.min_by(F.struct("y", "text"), F.struct(F.xxhash64("text"), "text")).alias("r"))
    one = one.select("lid", "r.*").withColumn("size", F.octet_length("text")).where(F.col("size") <= SAMPLE_BYTES // 100)
    # at most 2 * sample rows
    so_far = F.sum("size").over(Window.partitionBy("y").orderBy(h, "lid"))
    one = one.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES)
    rows = one.orderBy("lid").select("y", "text").toArrow().to_pylist()
    toxic, clean = [r["text"] for r in rows if r["y"] == 1], [r["text"] for r in rows if r["y"] == 0]
    if not toxic or not clean:
        share = float(bool(toxic))
        return Model({}, {}, [0.0] * 5, 30.0 if share else -30.0)
    words, stems = learn_terms(toxic, clean)
    lex = Lexicon(words, stems)
    x = np.array([lex.features(t) for t in toxic + clean])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    coef, bias = logistic(x, y)
    return Model(words, stems, coef, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each document; one pass, no shuffle."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        lex = _ready(m)
        for b in batches:
            x = np.array([lex.features(t or "") for t in b.column(1).to_pylist()]).reshape(-1, 5)
            s = 1 / (1 + np.exp(-np.clip(x @ np.array(m.coef) + m.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


_lexicons: dict[str, Lexicon] = {}


def _ready(m: Model) -> Lexicon:
    """A worker's automaton, kept between tasks."""
    key = repr((m.words, m.stems))
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = m.lexicon()
    return _lexicons[key]


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    s = score(docs, fit(docs, labels, sample))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_only(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score is under 0.5, unchanged; the score is computed beside the row, so nothing is joined."""
    prepare(docs.sparkSession)
    model = fit(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        lex = _ready(m)
        for b in batches:
            x = np.array([lex.features(str(t or "")) for t in b.column(at).to_pylist()]).reshape(-1, 5)
            yield b.filter(pa.array(x @ np.array(m.coef) + m.bias < 0))

    return docs.mapInArrow(run, docs.schema)
