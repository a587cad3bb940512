"""Toxicity: a counterfactually regularised linear classifier of sentences.

A text is cut into sentences (at ``.``, ``!``, ``?`` and line feeds; longer ones each 40 words).  A lower-case word has itself and
its first 3 to 7 letters as features, so that unseen forms of a known stem count; the logit of a sentence is the sum of the weights of its distinct words' features.  A text is as toxic as its most toxic sentence, so that one
insult in a long text counts.  Labels belong to whole texts; in training the sentence with the highest logit
answers for its text.

Training happens in numpy on the driver, on a bounded sample of labelled texts: at most ``sample_rows`` of them, none longer than ``sample_chars``.
Near copies in it count once, so that one copied text isn't evidence many times.  Features are chosen that toxic texts hold more often than
chance explains (likelihood ratio, at a level that allows for the number of features tried), of a word and its beginnings only the most telling; their weights are fitted by gradient descent.  A
counterfactual term is added to the loss: in every labelled sentence with an identity term that term is swapped for each other term of its group
and for a neutral word, and the squared change of the logit is penalised.  So a group that is often named in toxic texts doesn't make a neutral mention of
it toxic, and members of a group are treated alike.

Prediction reads every text whole, in slices of bounded size, without a shuffle.  Null and empty texts, and texts without a known
word, get the score of the bias alone.  Without labelled rows every score is 0; with one label only, all scores are equal.  Ids that
are labelled more than once are toxic if one label says so; of repeated ids one text is learned from (the smallest), and all are scored.
Equal texts get equal scores.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mix, slices

#: Bounds of the sample that is learned from, and of its vocabulary.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 30_000
VOCABULARY, LEAST_TEXTS = 100_000, 3
STEMS = (3, 4, 5, 6, 7)
SENTENCE_WORDS = 40
STEPS, RATE = 200, 0.05
RIDGE = 1e-3
#: How many features may be chosen by chance alone, on average.
BY_CHANCE = 0.05
#: Minima that are compared to find near copies in the sample.
MINIMA = 8
#: The weight of the counterfactual term.
FAIRNESS = 10.0
SEED = 13
#: Beyond this length tokens are not held as a list.
LONG = 1 << 20
#: How many words a process remembers.
WORDS_HELD = 1 << 17

#: Terms that may stand for one another in a sentence; a parameter of ``train``.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
)

_TOKEN = re.compile(r"\w+|[.!?\n]")
_ENDS = ".!?\n"


def _features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if k < len(word))]


class Reader(dict):
    """What is known of each word: the number of its set of features; 0 for none, -1 for the end of a sentence."""

    def __init__(self, features: list[str]):
        super().__init__(dict.fromkeys(_ENDS, -1))
        self.number = {f: i for i, f in enumerate(features, 1)}
        self.sets: dict[tuple[int, ...], int] = {(): 0}

    def of(self, word: str) -> tuple[int, ...]:
        return tuple(self.number[f] for f in _features(word) if f in self.number)

    def __missing__(self, word: str) -> int:
        found = self.of(word)
        code = self.sets.setdefault(found, len(self.sets))
        if len(self) > WORDS_HELD:
            self.clear()
            self.update(dict.fromkeys(_ENDS, -1))
        self[word] = code
        return code

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """``(sentence, set of features)`` of the known words of a text, each once a sentence."""
        low = text.lower()
        words = (m[0] for m in _TOKEN.finditer(low)) if len(low) > LONG else _TOKEN.findall(low)
        codes = np.fromiter(map(self.__getitem__, words), np.int32)
        known = np.flatnonzero(codes > 0)
        if not len(known):
            return known, known
        last = np.maximum.accumulate(np.where(codes < 0, np.arange(len(codes)), -1))
        # a piece of a sentence is named by where it begins
        begins = last[known] + 1 + (known - last[known] - 1) // SENTENCE_WORDS * SENTENCE_WORDS
        pairs = np.unique(begins.astype(np.int64) << 32 | codes[known])
        return np.unique(pairs >> 32, return_inverse=True)[1], pairs & 0xFFFFFFFF


@dataclass(frozen=True)
class Model:
    """Weights of the features that matter, and the bias; None if there was nothing to learn from."""

    weights: dict[str, float]
    bias: float | None

    def scorer(self):
        reader, weights = Reader(list(self.weights)), np.array([0.0, *self.weights.values()])
        values: list[float] = []

        def score(text: str | None) -> float:
            if self.bias is None:
                return 0.0
            most = 0.0
            if text:
                sentence, codes = reader.codes(text)
                if len(codes):
                    values.extend(weights[list(f)].sum() for f in list(reader.sets)[len(values) :])
                    most = max(0.0, float(np.bincount(sentence, np.array(values)[codes]).max()))
            return float(1 / (1 + np.exp(-np.clip(self.bias + most, -500, 500))))

        return score


def sample(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most ``rows`` labelled texts, chosen by a hash of their id: ``key``, ``text``, ``toxic``."""
    known = labels.where(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(F.col(key).alias("id")).agg((F.max(label) > 0).alias("toxic"))
    drawn = known.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(rows)  # ids only; texts follow by a broadcast join of this many rows
    short = documents.where(F.length(text) <= chars).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return short.join(F.broadcast(drawn), F.col("key") == F.col("id")).groupBy("key", "toxic").agg(F.min("text").alias("text"))


def _swaps(groups: tuple, reader: Reader, said: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Each counterfactual as a change of features, and its share: in how many sentences the term stands, shared out to its partners and the neutral word."""
    rows, shares = [], []
    for group in groups:
        for term in group:
            for other in (*(x for x in group if x != term), None):
                change = np.zeros(len(reader.number) + 1)
                np.add.at(change, list(reader.of(term)), 1)
                if other:
                    np.add.at(change, list(reader.of(other)), -1)
                if said[term] and change.any():
                    rows.append(change)
                    shares.append(said[term] / len(group))
    return np.array(rows).reshape(-1, len(reader.number) + 1), np.array(shares)


def _without_copies(texts: list[str]) -> list[int]:
    """Numbers of the texts that share no MinHash of their five-word runs with an earlier one."""
    held: list[set] = [set() for _ in range(MINIMA)]
    odd = (np.random.default_rng(SEED).integers(1, 2**63, MINIMA, np.uint64) << np.uint64(1)) | np.uint64(1)
    out = []
    for i, t in enumerate(texts):
        h = hashed_words([t.lower().encode().split()])[0]
        if len(h) < 5:
            out.append(i)
            continue
        n = len(h) - 4
        run = h[:n].copy()
        for j in range(1, 5):
            run = mix(run * np.uint64(31) + h[j : j + n])
        least = [int(mix(run * m).min()) for m in odd]
        if not any(x in seen for x, seen in zip(least, held, strict=True)):
            out.append(i)
        for x, seen in zip(least, held, strict=True):
            seen.add(x)
    return out


def _telling(texts: list[str], y: np.ndarray) -> list[str]:
    """Features that toxic texts hold more often than chance explains, the most telling first; of a word and its beginnings one."""
    count: tuple[Counter, Counter] = (Counter(), Counter())
    for t, toxic in zip(texts, y, strict=True):
        count[int(toxic)].update({f for w in set(_TOKEN.findall(t.lower())) if w not in _ENDS for f in _features(w)})
    both = count[0] + count[1]
    tried = sorted((w for w, k in both.items() if k >= LEAST_TEXTS), key=lambda w: (-both[w], w))[:VOCABULARY]
    k, m, rate = np.array([count[1][w] for w in tried], float), np.array([both[w] for w in tried], float), y.mean()
    part = lambda x, share: x * np.log(np.maximum(x, 1e-12) / np.maximum(m * share, 1e-12))
    gain = 2 * (part(k, rate) + part(m - k, 1 - rate))
    chosen = np.flatnonzero((k > m * rate) & (gain > 2 * np.log(max(1, len(tried)) / BY_CHANCE)))
    out: list[str] = []
    for i in sorted(chosen, key=lambda i: (-gain[i], -len(tried[i].rstrip("*")))):  # of equal ones the longest
        f = tried[i]
        stem = f.rstrip("*")
        if not any(stem.startswith(o.rstrip("*")) or o.startswith(stem) for o in out):
            out.append(f)
    return out


def fit(texts: list[str], toxic: np.ndarray, groups: tuple = IDENTITY_GROUPS, fairness: float = FAIRNESS) -> Model:
    """Learn from texts and whether they are toxic."""
    own = _without_copies(texts)
    texts, y = [texts[i] for i in own], np.asarray(toxic, float)[own]
    n = len(texts)
    if not n:
        return Model({}, None)
    words = _telling(texts, y) if 0 < y.sum() < n else []
    if not words:
        return Model({}, float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))))
    terms = Reader([x for g in groups for x in g])
    said: Counter = Counter()
    for t in texts:
        said.update(terms.codes(t)[1].tolist())
    said = Counter({x: said[terms[x]] for g in groups for x in g})
    reader, size = Reader(words), len(words) + 1
    change, share = _swaps(groups, reader, said)
    # feature 0 has no weight: every text has an empty sentence
    sentence, word, owner, at = [], [], [], 0
    for i, t in enumerate(texts):
        s, codes = reader.codes(t)
        pieces = int(s.max()) + 1 if len(s) else 0
        known = list(reader.sets)
        features = [known[c] for c in codes]
        sentence += [np.array([at]), np.repeat(s + at + 1, [len(f) for f in features])]
        word += [np.array([0]), np.array([x for f in features for x in f], int)]
        owner.append(np.full(pieces + 1, i))
        at += pieces + 1
    s, w, of = np.concatenate(sentence).astype(np.int64), np.concatenate(word).astype(np.int64), np.concatenate(owner)
    begins, first = np.flatnonzero(np.diff(s, prepend=-1)), np.flatnonzero(np.diff(of, prepend=-1))
    # start where each feature alone, and texts without any, are judged by their share of toxic ones
    held = np.unique(np.stack([of[s], w])[:, w > 0], axis=1)
    toxic_with, with_it = np.bincount(held[1], y[held[0]], size), np.bincount(held[1], minlength=size)
    other = np.setdiff1d(np.arange(n), held[0])
    odds = lambda k, m: np.log((k + 0.5) / (m - k + 0.5))
    bias = float(odds(y[other].sum(), len(other)))
    v = np.maximum(odds(toxic_with, with_it) - bias, 0)
    v[0] = 0
    # the counterfactual term is quadratic: each step on the loss is followed by an exact (proximal) one on the term
    settle = np.linalg.inv(np.eye(size) + 2 * fairness / n * (change.T @ (share[:, None] * change)))
    squares, bias_squares = np.full(size, 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.add.reduceat(v[w], begins)
        most = np.maximum.reduceat(z, first)
        held = np.flatnonzero(z == most[of])
        answers = held[np.unique(of[held], return_index=True)[1]]
        error = 1 / (1 + np.exp(-np.clip(most + bias, -500, 500))) - y
        text = np.full(len(z), -1)
        text[answers] = of[answers]
        text = text[s]
        g = np.bincount(w[text >= 0], error[text[text >= 0]], size) / n + RIDGE * v / n
        g[0] = 0
        squares += g * g
        v = settle @ (v - RATE * g / np.sqrt(squares))
        bias_squares += error.mean() ** 2
        bias -= RATE * error.mean() / np.sqrt(bias_squares)
    return Model({words[i - 1]: float(v[i]) for i in range(1, size)}, float(bias))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, groups: tuple = IDENTITY_GROUPS, fairness: float = FAIRNESS) -> Model:
    """Learn from the labelled texts of ``documents``; rows that must not be learned from are left out by the caller."""
    rows = sorted(sample(documents, labels, key, text, label, sample_rows, sample_chars).select("key", "text", "toxic").collect())  # sample_rows texts of at most sample_chars
    return fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows], float), groups, fairness)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` (0 to 1) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in slices(batches, "text"):
            found = pa.array([score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), found], ["key", "score"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: the CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(3)) == 1, F.lit(False))
