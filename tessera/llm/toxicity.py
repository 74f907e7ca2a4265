"""Toxicity by Levenshtein automata intersected with a lexicon trie.

*Fit*, on at most ``MAX_LABELLED`` labelled rows (chosen by a hash of doc_id; rows whose crc32(doc_id as
text) mod 5 is 0 are held out): words and word beginnings that mark toxic documents form the lexicon
(all of them; their number is bounded by the sample); the words that a beginning covers in toxic documents stay in the trie, so that their misspellings
are found; words of clean documents near a term are known words, not misspellings; a
logistic regression on three sums of hit scores gives the probability.

*Score*: the terms are in a trie. The Levenshtein automaton of a term (one edit, from five letters on)
and the trie are walked together; their joint states are made once and kept, so a word costs a table
look-up for each letter, and a repeated word one. A hit counts in full where it stands free, and
``QUOTED`` of it where its context window reads as a quotation (quotation marks around it, or a
reporting word shortly before). Inputs of a score are the text alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, give_back, text_of, written
from .tokens import forget

MAX_LABELLED = 20_000
#: A term is in this many toxic documents of the sample at least, at odds so many times those of clean ones,
#: and so much likelier there than by chance (log of the likelihood ratio).
LEAST_DOCUMENTS, LEAST_ODDS, LEAST_EVIDENCE = 3, 20.0, 12.0
FUZZY_LETTERS = 5
FUZZY, QUOTED = 0.6, 0.25
MISSPELLED = 0.25
WINDOW_CHARS, WINDOW_WORDS = 80, 4
#: Words whose look-up a task keeps, about 170 bytes each.
MEMO_ENTRIES = 200_000
FAMILY_HASHES = 8
STEMS = (4, 5, 6)

_WORD = re.compile(r"[^\W_]+")
_OPEN, _CLOSE, _BOTH = "“„«‹‘", "”“»›’", "\""
#: Words that report speech.
REPORTING = frozenset("said says wrote writes quote quoted quotes called calls according sagte schrieb zitat nannte laut dit écrit cité selon appelé dijo escribió cita según llamó".split())


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    known: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [-4.0, 3.0, 2.0, 1.0])
    #: Words behind the stems: looked up with an edit only, as without one the stem is found.
    forms: frozenset[str] = frozenset()


class LexiconAutomaton:
    """Joint states of the trie and the Levenshtein automata, made as words need them."""

    def __init__(self, model: Model):
        self.model = model
        self.child: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.form: list[str | None] = [None]
        for terms, marks in ((model.words, self.word), (model.stems, self.stem), (model.forms, self.form)):
            for t in terms:
                node = 0
                for c in t:
                    if c not in self.child[node]:
                        self.child.append({})
                        self.word.append(None)
                        self.stem.append(None)
                        self.form.append(None)
                        self.child[node][c] = len(self.child) - 1
                    node = self.child[node][c]
                marks[node] = t
        self.states: list[dict[int, int]] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})
        self.memo: dict[str, tuple[str, float] | None] = {}

    def _state(self, at: dict[int, int]) -> int:
        """The number of the state: trie nodes with the edits that led there; letters of a term may be left out."""
        todo = list(at.items())
        while todo:
            node, edits = todo.pop()
            if edits < 1:
                for to in self.child[node].values():
                    if at.get(to, 2) > edits + 1:
                        at[to] = edits + 1
                        todo.append((to, edits + 1))
        key = tuple(sorted(at.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(at)
            self.moves.append({})
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        to: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if to.get(node, 2) > edits:
                to[node] = edits

        for node, edits in self.states[state].items():
            if c in self.child[node]:
                reach(self.child[node][c], edits)
            if edits < 1:
                reach(node, edits + 1)
                for x in self.child[node].values():
                    reach(x, edits + 1)
        self.moves[state][c] = found = self._state(to) if to else self.dead
        return found

    def _look(self, word: str) -> tuple[str, float] | None:
        node = 0
        stem = None
        for c in word:  # a stem is a beginning, without edits
            node = self.child[node].get(c, -1)
            if node < 0:
                break
            stem = self.stem[node] or stem
        if node >= 0 and self.word[node]:
            return self.word[node], 1.0
        if stem:
            return stem, 1.0
        if len(word) < FUZZY_LETTERS - 1 or word in self.model.known:
            return None
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == self.dead:
                return None
        near = [t for n in self.states[state] if (t := self.word[n] or self.form[n]) and len(t) >= FUZZY_LETTERS]
        return (min(near), FUZZY) if near else None

    def hit(self, word: str) -> tuple[str, float] | None:
        """The term that the word is or misspells, and how sure that is."""
        memo = self.memo
        if word in memo:
            return memo[word]
        if len(memo) >= MEMO_ENTRIES:
            memo.clear()
        memo[word] = found = self._look(word)
        return found

    def features(self, text: str) -> tuple[float, float, float]:
        low = text.lower()
        words = _WORD.findall(low)
        hit = self.hit
        found = {w: h for w in set(words) if (h := hit(w))}
        if not found:
            return 0.0, 0.0, 0.0
        total = most = 0.0
        before: list[str] = []
        for m in _WORD.finditer(low):
            w = m[0]
            if w in found:
                score = found[w][1] * (QUOTED if quoted(low, m.start(), m.end(), before) else 1.0)
                total += score
                most = max(most, score)
            before.append(w)
            if len(before) > WINDOW_WORDS:
                del before[0]
        return math.log1p(total), most, total / math.sqrt(len(words) + 1)

    def score(self, text: str) -> float:
        b, *w = self.model.weights
        z = b + sum(x * y for x, y in zip(w, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def quoted(text: str, start: int, end: int, before: list[str]) -> bool:
    """Whether the context window of text[start:end] reads as a quotation."""
    if not REPORTING.isdisjoint(before):
        return True
    left, right = text[max(0, start - WINDOW_CHARS) : start].rpartition("\n")[2], text[end : end + WINDOW_CHARS].partition("\n")[0]
    opened = max(left.rfind(c) for c in _OPEN)
    if opened >= 0 and not any(c in left[opened + 1 :] for c in _CLOSE) and any(c in right for c in _CLOSE):
        return True
    return left.count(_BOTH) % 2 == 1 and _BOTH in right


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, mod 5; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def _labelled(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """text and toxic of at most about bound labelled rows that aren't held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).filter(remainder() != 0)
    n = known.count()
    if n > bound:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("labelled")), F.lit(n)) < bound)
    # about bound rows of 12 bytes: small to broadcast by that bound
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")


def _weighted(sample: DataFrame) -> DataFrame:
    """text, toxic, weight: a document weighs one over the size of its family of copies and near copies in
    the sample (the mean number of documents that share one of its minima of hashed word triples), so a family counts once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.array([2 * k * 0x9E3779B97F4A7C15 + 0xC2B2AE3D27D4EB4F & (1 << 64) - 1 for k in range(FAMILY_HASHES)], dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            minima = []
            for text in batch.column(0).to_pylist():
                words = text.split()
                triples = {zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))}
                hashed = np.fromiter(triples, dtype=np.uint64)[:, None] * factor
                minima.append(((hashed ^ (hashed >> np.uint64(29))) * factor >> np.uint64(2)).min(axis=0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(minima, pa.list_(pa.int64()))], [*batch.schema.names, "minima"])

    signed = written(sample.mapInArrow(sign, "text string, toxic int, minima array<bigint>").withColumn("id", F.monotonically_increasing_id()), "families")
    rows = signed.select("id", F.posexplode("minima").alias("k", "v"))
    family = rows.join(rows.groupBy("k", "v").agg(F.count("*").alias("n")), ["k", "v"]).groupBy("id").agg((1 / F.avg("n")).alias("weight"))
    # a row for each of the bounded sample
    return written(signed.join(F.broadcast(family), "id").select("text", "toxic", "weight"), "weighted")


def _stems_of(word: str) -> list[str]:
    return [word[:k] + "*" for k in STEMS if len(word) > k]


def _counts(sample: DataFrame) -> DataFrame:
    """term (a word, or a beginning and *), toxic and clean documents that have it, and seen: in toxic
    documents, the different words of a document that have it, summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[dict, dict] = (defaultdict(float), defaultdict(float))
        seen: dict[str, float] = defaultdict(float)
        for batch in batches:
            for text, toxic, weight in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = {w for w in set(_WORD.findall(text.lower())) if len(w) > 2}
                stems = [s for w in words for s in _stems_of(w)]
                for term in chain(words, set(stems)):
                    by[toxic][term] += weight
                if toxic:
                    for term in chain(words, stems):
                        seen[term] += weight
        terms = list(by[0].keys() | by[1].keys())
        for at in range(0, len(terms), 50_000):
            some = terms[at : at + 50_000]
            counts = {"toxic": by[1], "clean": by[0], "seen": seen}
            yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.string())} | {k: pa.array([c.get(t, 0.0) for t in some], pa.float64()) for k, c in counts.items()})

    return sample.mapInArrow(count, "term string, toxic double, clean double, seen double").groupBy("term").agg(*(F.sum(k).alias(k) for k in ("toxic", "clean", "seen")))


def _lexicon(rows: list[tuple[str, float, float]], n_toxic: float, n_clean: float) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems from (term, toxic documents, clean documents); a stem stays if no word and no longer stem explains it."""
    odds = {t: math.log(((a + 0.5) / (n_toxic + 1)) / ((b + 0.5) / (n_clean + 1))) for t, a, b in rows}
    count = {t: a for t, a, _ in rows}
    words = {t for t in odds if not t.endswith("*")}
    most: dict[str, float] = {}
    for t in odds:
        for s in _stems_of(t.rstrip("*")) if t in words else [t[:k] + "*" for k in STEMS if k < len(t) - 1]:
            weight = count[t] if t in words else count[t] if count[t] >= 0.95 * count.get(s, 0) else 0
            most[s] = max(most.get(s, 0), weight)
    stems = {t for t in odds if t.endswith("*") and most.get(t, 0) < 0.7 * count[t]}
    stems = {s for s in stems if not any(s[:k] + "*" in stems for k in STEMS if k < len(s) - 1)}
    words = {w for w in words if not any(s in stems for s in _stems_of(w))}
    return {w: odds[w] for w in words}, {s[:-1]: odds[s] for s in stems}


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model:
    sample = _weighted(_labelled(docs, labels, bound))
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, {})
    odds = F.log(((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1)))
    share = n_toxic / (n_toxic + n_clean)
    a, b = F.col("seen").cast("double"), F.col("clean").cast("double")
    evidence = a * F.log(a / (a + b) / share) + F.when(b > 0, b * F.log(b / (a + b) / (1 - share))).otherwise(0.0)
    counted = _counts(sample).filter((F.col("toxic") >= LEAST_DOCUMENTS) & (odds >= math.log(LEAST_ODDS)))
    top = counted.filter(evidence >= LEAST_EVIDENCE)  # terms of the bounded sample
    words, stems = _lexicon(sorted((r.term, r.toxic, r.clean) for r in top.collect()), n_toxic, n_clean)
    model = Model(words, stems)
    beginnings = tuple(stems)

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {w for batch in batches for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if toxic for w in set(_WORD.findall(text.lower())) if len(w) >= FUZZY_LETTERS and w.startswith(beginnings)}
        yield pa.RecordBatch.from_pydict({"word": pa.array(sorted(found), pa.string())})

    # words of the bounded sample's toxic documents
    model.forms = frozenset(r.word for r in sample.mapInArrow(behind, "word string").distinct().collect())

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = LexiconAutomaton(model)
        found = {w for batch in batches for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not toxic for w in set(_WORD.findall(text.lower())) if (h := a.hit(w)) and h[1] == FUZZY}
        yield pa.RecordBatch.from_pydict({"word": pa.array(sorted(found), pa.string())})

    # words of the bounded sample's clean documents
    model.known = frozenset(r.word for r in sample.mapInArrow(near, "word string").distinct().collect())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = LexiconAutomaton(model)
        for batch in batches:
            x = [a.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({f"x{k}": pa.array([v[k] for v in x], pa.float64()) for k in range(3)} | {"toxic": batch.column(1)})

    rows = sample.mapInArrow(measure, "x0 double, x1 double, x2 double, toxic int").groupBy("x0", "x1", "x2", "toxic").count().collect()
    x = np.array([[1.0, r.x0, r.x1, r.x2] for r in rows])
    y, n = np.array([r.toxic for r in rows], float), np.array([r["count"] for r in rows], float)
    # labelled rows may have no misspelled term: each toxic row also counts, lightly, as one with a single misspelled hit
    single = np.array([[1.0, math.log1p(FUZZY), FUZZY, FUZZY / math.sqrt(200)]])
    model.weights = logistic(np.vstack([x, single]), np.append(y, 1.0), np.append(n, MISSPELLED * (n @ y))).tolist()
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; rows count n times, the first column is free of the ridge."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-4
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + penalty * w
        h = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, gradient)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (all columns) with a last column score; null text is scored as empty; repeated rows each; a column score of docs is
    replaced; a text of any length is scored whole."""
    docs = dealt(docs.drop("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        a = LexiconAutomaton(shared.value)
        for batch in batches:
            scores = [a.score(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])
        del a
        give_back()

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Without labels of both classes every score is that of no hits."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
