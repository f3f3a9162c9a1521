"""Toxicity: a learnt lexicon, misspellings by Levenshtein automata on its trie, and the context of each find.

From a bounded sample of labelled rows come the lexicon (words, and stems that begin words, that are far likelier in
toxic texts), the weights of words in a window around finds, and a logistic model. Finding runs an automaton that is the
intersection of the lexicon's trie with the Levenshtein automata of its terms, made deterministic as words are met; a
word that no term is near to fails within its first letters. Quotation marks around a find and the words in its window
tell mentions from abuse.

Defined results: null and empty texts have no finds and the score of such texts; without labelled rows of both kinds
every score is 0; an empty table gives no rows; null and repeated ids stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: At most so many labelled rows of either kind are learnt from, whole texts.
SAMPLE_ROWS = 2000
WINDOW, SHORTEST, MISSPELT_FROM = 6, 4, 5
#: Distinct runs of characters a worker remembers.
REMEMBERED = 500_000
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = "\"'«»„“”‚‘’`"
_STEM = "*"


class Automaton:
    """Terms within one edit: states are sets of (trie node, edits); made as they are met."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.terms = terms
        for k, term in enumerate(terms):
            at = 0
            for c in term.removesuffix(_STEM):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                at = self.children[at][c]
            (self.stem if term.endswith(_STEM) else self.word)[at] = k
        start = frozenset([(0, 0)])
        self.states, self.number = [start], {start: 0}
        self.moves: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int] | None] = [self._end(start)]
        self.stems: list[int] = [self._stem(start)]

    def _end(self, state) -> tuple[int, int] | None:
        """(edits, term) if a word may end here."""
        found = []
        for node, edits in state:
            if self.word[node] >= 0 and (not edits or len(self.terms[self.word[node]]) >= MISSPELT_FROM):
                found.append((edits, self.word[node]))
            if not edits:  # a last letter is missing
                found += [(1, self.word[x]) for x in self.children[node].values() if self.word[x] >= 0 and len(self.terms[self.word[x]]) >= MISSPELT_FROM]
        return min(found, default=None)

    def _stem(self, state) -> int:
        return max((self.stem[node] for node, edits in state if not edits), default=-1)

    def _move(self, s: int, c: str) -> int:
        to = set()
        for node, edits in self.states[s]:
            below = self.children[node]
            if c in below:
                to.add((below[c], edits))
            if not edits:
                to.add((node, 1))  # a letter too many
                for other, x in below.items():
                    if other != c:
                        to.add((x, 1))  # another letter
                    if c in self.children[x]:
                        to.add((self.children[x][c], 1))  # a letter missing
        to = frozenset(x for x in to if not (x[1] and (x[0], 0) in to))
        if to not in self.number:
            self.number[to] = len(self.states) if to else -1
            if to:
                self.states.append(to)
                self.moves.append({})
                self.ends.append(self._end(to))
                self.stems.append(self._stem(to))
        self.moves[s][c] = self.number[to]
        return self.number[to]

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, a stem counting as exact; None if none is near."""
        s, moves = 0, self.moves
        for c in word:
            nxt = moves[s].get(c)
            if nxt is None:
                nxt = self._move(s, c)
            if nxt < 0:
                return None
            s = nxt
            if self.stems[s] >= 0:
                return 0, self.stems[s]
        return self.ends[s]


def lexicon(texts: list[str], toxic: np.ndarray, ratio: float = 20.0, share: float = 0.003) -> dict[str, float]:
    """Terms and their log ratios: words, and stems of words, `ratio` times as frequent in toxic texts as in others."""
    counts = [Counter(), Counter()]
    for text, y in zip(texts, toxic.tolist(), strict=True):
        counts[y].update(set(_WORD.findall(text.lower())))
    terms = [Counter(), Counter()]
    for y in (0, 1):
        for word, n in counts[y].items():
            if len(word) >= SHORTEST:
                terms[y][word] += n
            for k in range(SHORTEST - 1, min(len(word), 12) + 1):
                terms[y][word[:k] + _STEM] += n
    total = [max(1, int((toxic == y).sum())) for y in (0, 1)]
    least = max(4, share * total[1])
    good = {}
    for term, n in terms[1].items():
        odds = (n + 0.5) / total[1] / ((terms[0][term] + 0.5) / total[0])
        if n >= least and odds >= ratio:
            good[term] = float(np.log(odds))
    kept = {}
    for term, weight in sorted(good.items(), key=lambda x: len(x[0])):
        body = term.removesuffix(_STEM)
        misspelt = body == term and len(body) >= MISSPELT_FROM  # stems have no misspellings, so such a word stays beside its stem
        if not misspelt and any(body[:k] + _STEM in kept for k in range(SHORTEST - 1, len(body) + 1)):
            continue  # a shorter stem has it
        if term.endswith(_STEM) and terms[1][term] <= 1.1 * terms[1][body]:
            continue  # hardly more than the word itself, which will do
        kept[term] = weight
    return kept


class Model:
    """Everything a task needs to score texts."""

    def __init__(self, terms: dict[str, float]):
        self.weights = list(terms.values())
        self.automaton = Automaton(list(terms))
        self.context: dict[str, float] = {}
        self.coefficients: np.ndarray | None = None
        self.known: dict[str, tuple[int, int] | None] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def _check(self, run: str) -> tuple[int, int] | None:
        found = min((f for w in _WORD.findall(run) if len(w) >= SHORTEST - 1 and (f := self.automaton.find(w))), default=None)
        if len(self.known) < REMEMBERED:
            self.known[run] = found
        return found

    def finds(self, text: str | None) -> tuple[list[str], list[tuple[int, int, int]]]:
        """The runs of a text between white space, and (place, edits, term) of finds."""
        runs, known = (text or "").lower().split(), self.known
        out = []
        for i, r in enumerate(runs):
            f = known[r] if r in known else self._check(r)
            if f is not None:
                out.append((i, *f))
        return runs, out

    def window(self, runs: list[str], place: int) -> list[str]:
        near = runs[max(0, place - WINDOW) : place] + runs[place + 1 : place + 1 + WINDOW]
        return [w for r in near for w in _WORD.findall(r)]

    def features(self, text: str | None) -> list[float]:
        runs, found = self.finds(text)
        exact, near, quoted, context, heaviest = 0, 0, 0, 0.0, 0.0
        marks = np.cumsum([sum(r.count(q) for q in "\"«»„“”") for r in runs]) if found else None
        for place, edits, term in found:
            exact += not edits
            near += edits > 0
            open_ = marks[place - 1] % 2 == 1 if place else False
            quoted += bool(open_ or runs[place][:1] in _QUOTES or runs[place][-1:] in _QUOTES)
            words = self.window(runs, place)
            context += sum(self.context.get(w, 0.0) for w in words) / max(1, len(words))
            heaviest = max(heaviest, self.weights[term] * (0.5 if edits else 1.0))
        n = max(1, len(found))
        return [1.0, np.log1p(exact), float(exact > 0), np.log1p(near), heaviest / 8, quoted / n, context / n, np.log1p(1000 * exact / (len(runs) + 50))]

    def learn_context(self, texts: list[str], toxic: np.ndarray) -> None:
        seen = [Counter(), Counter()]
        for text, y in zip(texts, toxic.tolist(), strict=True):
            runs, found = self.finds(text)
            for place, _, _ in found:
                seen[y].update(self.window(runs, place))
        total = [sum(c.values()) + 20 for c in seen]
        both = seen[0] + seen[1]
        self.context = {w: float(np.log((seen[1][w] + 10) / total[1] / ((seen[0][w] + 10) / total[0]))) for w, n in both.most_common(2000) if n >= 5}

    def learn(self, texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression by Newton's method with a small ridge."""
        x = np.array([self.features(t) for t in texts])
        b = np.zeros(x.shape[1])
        ridge = np.diag([1e-3, *[1.0] * (len(b) - 1)])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, x.T @ (weight * (toxic - p)) - ridge @ b)
            b += step
            if np.abs(step).max() < 1e-8:
                break
        self.coefficients = b

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(text), self.coefficients), -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, learnt_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from at most sample_rows labelled rows of each kind (drawn by a hash of the id) for which learnt_from holds."""
    rows = labels.where(learnt_from & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None
    def below(draw, total: int):
        """Whether a draw is among so many of `total` as should be sample_rows."""
        share = min(1.0, sample_rows / max(1, total))
        return draw <= F.lit(int(2**64 * share - 2**63) - (share == 1.0))

    draw = F.xxhash64("id", F.lit("sample"))
    picked = rows.where(F.when(F.col("y") == 0, below(draw, totals[0])).otherwise(below(draw, totals[1]))).distinct()
    picked = F.broadcast(picked)  # bounded: some 2 * sample_rows pairs of numbers
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")
    sample = common.stash(docs.select(F.col(id_col).cast("long").alias("id"), body).join(picked, "id").distinct(), "sample")
    share = sample.where(below(F.xxhash64("id", "body"), sample.count() // 2))  # an id may be on many rows
    sample = share.toPandas().sort_values(["id", "body", "y"])
    if sample["y"].nunique() < 2:
        return None
    texts, toxic = sample["body"].tolist(), sample["y"].to_numpy()
    model = Model(lexicon(texts, toxic))
    model.learn_context(texts, toxic)
    share = np.array([totals[0] / (toxic == 0).sum(), totals[1] / (toxic == 1).sum()])
    model.learn(texts, toxic, (share / share.min())[toxic])
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> Column:
    """A column with the score of each whole text."""
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was learnt from

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(np.zeros(len(texts)))
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return judge(F.col(text_col).cast("string"))


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: id_col, held_out, score, predicted. Learns from labelled rows that aren't held out."""
    out = common.held_out(F.col(id_col))
    model = fit(docs, labels, ~out, id_col, text_col, label_col)
    scored = docs.select(F.col(id_col).cast("long").alias(id_col), out.alias("held_out"), score(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
