"""Toxicity: a lexicon trie met by Levenshtein automata, with scores of the words around each hit.

The lexicon is learned from the labelled rows: words, and beginnings of words,
that are much more frequent in documents labelled toxic.  A trie holds it.  A
word walks the trie together with the automaton of all strings within one edit
(insertion, deletion, substitution or a swap of neighbours), so that misspelled
terms are met without listing them.  A hit is then judged by its window: words
between quotation marks or after a reporting word count as quotation, words
near a form of address as abuse.  A logistic model of these counts gives the score.

Distinct words are walked once a worker; a map scores the documents, without a
shuffle.

Defined cases: null texts count as empty; an empty text, or one without any
hit, gets the base score of the model; without labels of both classes the
lexicon is empty and every score is the share of toxic labels (0 without
labels); repeated rows are scored each; rows without an id and other
columns are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, release, small_batches
from .labels import fold, training_rows
from .words import Known, batches, hash_spans, join, white_words

#: Bounds of the training sample (clean, toxic), of the lexicon, and of a term's beginnings.
SAMPLE = (6000, 3000)
LEXICON = 600
STEMS = range(4, 10)
LEAST_DOCS = 3
LEAST_ODDS = 1.5
FUZZY_FROM = 6
WINDOW_BYTES = 48
# Marks and words that tell quotation and address.
QUOTES = "\"'“”„‘’‚«»‹›"
REPORTING = frozenset("said says called wrote quote quoted term word sagte nannte dit appelle dijo llama".split())
ADDRESS = frozenset("you your youre you're u ur du dich dir dein ihr tu te toi vous votre tú usted eres".split())
LETTERS = re.compile(r"[^\W\d_]+")


def fold_word(word: str) -> str:
    """Lower case, composed, without marks around it."""
    return unicodedata.normalize("NFC", word).lower()


def terms_of(word: str) -> list[str]:
    """A word's candidate terms: itself with an end mark, and its beginnings."""
    return [word + "$"] * (len(word) >= 3) + [word[:n] for n in STEMS if len(word) >= n]


@dataclass
class Trie:
    """Terms by their letters; a node is a dict, and key '' holds the term that ends there."""
    root: dict = field(default_factory=dict)

    def add(self, term: str, value: int) -> None:
        node = self.root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = value

    def exact(self, word: str) -> int:
        """The value of the longest term that begins the word (or, with an end mark, is the word), else -1."""
        node, best = self.root, -1
        for c in word + "$":
            if c not in node:
                break
            node = node[c]
            best = node.get("", best)
        return best

    def near(self, word: str, least: int) -> int:
        """The value of the longest term of at least ``least`` letters that one edit away begins (or is) the word.

        States of the automaton are (place in the word, edits so far) beside a
        node; a node without a state left ends its branch.
        """
        text, best, found = word + "$", (0, 0), -1
        stack = [(self.root, 0, 0, 0)]
        seen = set()
        while stack:
            node, at, edits, depth = stack.pop()
            if (id(node), at, edits) in seen:
                continue
            seen.add((id(node), at, edits))
            if "" in node and edits == 1 and depth >= least and (depth, -node[""]) > best:
                best, found = (depth, -node[""]), node[""]
            c = text[at] if at < len(text) else None
            if c is not None and c in node:
                stack.append((node[c], at + 1, edits, depth + 1))
            if edits or at < 1:  # the first letter stands
                continue
            if c is not None and c != "$":
                stack.append((node, at + 1, 1, depth))  # one letter too many
                nxt = text[at + 1] if at + 1 < len(text) else None
                if nxt is not None and nxt != "$" and nxt in node and c in node[nxt]:
                    stack.append((node[nxt][c], at + 2, 1, depth + 2))  # two swapped
            for letter, child in node.items():
                if letter and letter != "$":
                    stack.append((child, at, 1, depth + 1))  # one missing
                    if c is not None and c != "$" and letter != c:
                        stack.append((child, at + 1, 1, depth + 1))  # one other
        return found


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray          # log odds of each term
    beta: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    spread: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))


N_FEATURES = 9


class Scorer:
    """Features of texts under one lexicon; what a word hits is kept a worker."""

    def __init__(self, model: Model):
        self.model, self.trie = model, Trie()
        for i, t in enumerate(model.terms):
            self.trie.add(t, i)
        # a word's code: 0 none, else 2 * (term + 1) for an exact hit and one more for a near one
        self.known, self.codes = Known(), np.zeros(0, np.int64)

    def code(self, raw: bytes) -> int:
        best = 0
        for w in LETTERS.findall(fold_word(raw.decode("utf-8", "replace"))):
            hit = self.trie.exact(w)
            if hit >= 0:
                return 2 * (hit + 1)
            if not best and len(w) >= FUZZY_FROM - 1 and (near := self.trie.near(w, FUZZY_FROM)) >= 0:
                best = 2 * (near + 1) + 1
        return best

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), N_FEATURES))
        raw = [t.encode() for t in texts]
        for a, b in batches(raw):
            buf, begins = join(raw[a:b])
            starts, ends, per_text = white_words(buf, begins)
            out[a:b, 6] = np.log1p(per_text)
            keys, first, place = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
            if self.known.n > self.known.limit:
                self.known, self.codes = Known(), np.zeros(0, np.int64)
            rows = self.known.find(keys)
            new = rows < 0
            if new.any():
                f, joined = first[new], buf.tobytes()
                self.codes = np.append(self.codes, [self.code(joined[s:e]) for s, e in zip(starts[f].tolist(), ends[f].tolist())]).astype(np.int64)
                rows[new] = self.known.add(keys[new])
            codes = self.codes[rows][place]
            hits = np.flatnonzero(codes)
            owner = np.searchsorted(begins, starts[hits], side="right") - 1
            seen: set = set()
            for h, i in zip(hits.tolist(), owner.tolist()):
                code, s, e = int(codes[h]), int(starts[h]), int(ends[h])
                # a byte window inside the same text
                left = buf[max(int(begins[i]), s - WINDOW_BYTES):s].tobytes().decode("utf-8", "ignore")
                right = buf[e:min(int(begins[i + 1]), e + WINDOW_BYTES)].tobytes().decode("utf-8", "ignore")
                self._judge(out[a + i], code, left, buf[s:e].tobytes().decode("utf-8", "replace"), right, (i, code) not in seen)
                seen.add((i, code))
        out[:, 4] = out[:, 0] / np.maximum(1.0, np.expm1(out[:, 6])) * 100  # hits in a hundred words
        out[:, [0, 1, 2, 3, 5, 7]] = np.log1p(out[:, [0, 1, 2, 3, 5, 7]])
        return out

    def _judge(self, row: np.ndarray, code: int, left: str, word: str, right: str, new: bool) -> None:
        """0 exact hits, 1 log odds of the distinct terms, 2 near hits, 3 quoted hits, 4 density, 5 addressed hits, 7 near log odds,
        8 the highest log odds of an exact hit."""
        term, near = divmod(code, 2)
        weight = self.model.weights[term - 1]
        around = set(LETTERS.findall(f"{left} {right}".lower()))
        opened = any(c in QUOTES for c in (left + word[:1])[-12:]) and any(c in QUOTES for c in (word[-1:] + right)[:12])
        if opened or REPORTING & set(LETTERS.findall(left.lower())[-3:]):
            row[3] += 1
            return
        row[5] += bool(ADDRESS & around)
        if near:
            row[2] += 1
            row[7] += weight * new
        else:
            row[0] += 1
            row[1] += weight * new
            row[8] = max(row[8], weight)

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.model
        z = np.clip((self.features(texts) - m.mean) / m.spread, -8, 8) @ m.beta[1:] + m.beta[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_SCORERS: dict = {}


def scorer_of(model: Model) -> Scorer:
    """One scorer a worker process, so that a word is walked once, not once a task."""
    key = (tuple(model.terms), model.weights.tobytes(), model.beta.tobytes())
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> tuple[list[str], np.ndarray]:
    """The terms of highest log likelihood ratio, from counts of documents made in Spark."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            n = {0: Counter(), 1: Counter()}
            for text, y in zip(pdf["text"], pdf["y"]):
                n[y].update({t for w in set(LETTERS.findall(fold_word(text))) for t in terms_of(w)})
            yield pd.DataFrame([(t, n[0][t], n[1][t]) for t in n[0].keys() | n[1].keys()], columns=["term", "clean", "toxic"])
    n0, n1 = (rows.where(F.col("y") == y).count() for y in (0, 1))
    if not n0 or not n1:
        return [], np.zeros(0)
    by_term = rows.mapInPandas(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    best = (by_term.withColumn("odds", odds).where((F.col("toxic") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
            .orderBy(F.desc(F.col("toxic") * F.col("odds")), F.desc(F.length("term")), "term").limit(3 * size).collect())
    # a beginning that is nearly always one longer term says no more than that term
    kept: list = []
    for r in sorted(best, key=lambda r: (-len(r.term), r.term)):
        if not any(k.toxic >= 0.9 * r.toxic and k.term.startswith(r.term) for k in kept):
            kept.append(r)
    kept = sorted(kept, key=lambda r: (-r.toxic * r.odds, r.term))[:size]
    return [r.term for r in kept], np.array([r.odds for r in kept])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method with a ridge; returns intercept and slopes, and the standardisation."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / spread, -8, 8)])
    beta, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta, mean, spread


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    held_out = fold(F.col("doc_id"), 5) == 0
    rows, totals = training_rows(docs, labels, "toxic", held_out, sample)
    terms, weights = learn_lexicon(rows)
    model = Model(terms, weights)
    share = totals[1] / max(1, sum(totals))
    model.beta[0] = np.log((share + 1e-9) / (1 - share + 1e-9))
    if not terms:
        return model

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in parts:
            yield pd.DataFrame({"x": list(scorer.features(pdf["text"].tolist())), "y": pdf["y"]})
    # at most sum(sample) rows of N_FEATURES numbers
    got = rows.mapInPandas(measure, "x array<double>, y int").toPandas()
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy(float)
    weight = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
    model.beta, model.mean, model.spread = fit_logistic(x, y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of(model)
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": scorer.scores(pdf["text"].tolist())})
        release()
    rows = documents(docs).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)))
    return (rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for batch in parts:
            yield batch.filter(pa.array(scorer.scores([t or "" for t in batch.column("text").to_pylist()]) < threshold))
        release()
    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
