"""Toxicity by a classifier chain of linear models on hashed features.

The chain predicts its categories one after the other. Each link is a logistic regression on a text's hashed word and
word-start features, and on the probabilities of all links before it. Those that train it are out-of-fold: each fold's come
from a link fitted on the other folds, so that a link learns from predictions as good as those it will get; the link that
scores is then fitted on all rows.

The categories are label columns, each with the value that means it: in tables of documents, whether a text was judged to be
of low quality, and whether it was judged toxic. Both are judgements by themselves; neither is made from the other.

Features: words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased and without punctuation at their ends, and their first four
and six letters, hashed into ``buckets``; a feature counts by the logarithm of how often the text has it, and a text's
vector is divided by its length. Only features that ``least`` labelled
texts have get a weight, and each is scaled by the logarithm of how much likelier texts of the category are to have it
(Wang and Manning, 2012), so that a few telling words count in a long text.

The models are fitted on at most ``most_labels`` labelled texts (those with the smallest hash of their id), which are
reduced to their buckets before they reach the driver. Texts are scored whole, in one pass, and never shuffled but for
the labelled ones.

Defined cases: a null text is empty; an empty one has no features, and the chain's biases decide; repeated rows and ids
give a row each; of labels that contradict each other the one that means the category holds; a null label takes no part in its
link, nor does a label without a document; texts of equal features have equal probabilities; a category without positives, or negatives, has a constant probability; extra columns are ignored;
an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.common import raw_texts, slices, words

EDGES = b".,;:!?|\"'()[]{}#*$%&<>"

#: (name, label column, value that means it), in the chain's order; the last decides.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


class Buckets(dict):
    """A word's feature buckets; emptied at ``most`` words."""

    def __init__(self, buckets: int, most: int = 300_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        bare = word.strip(EDGES)
        parts = {b"w" + bare, b"4" + bare[:4], b"6" + bare[:6]} if bare else ()
        out = tuple(sorted({xxhash.xxh32_intdigest(p) % self.buckets for p in parts}))
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out

    def vector(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and their values, of unit length."""
        seen: Counter = Counter()
        for word, n in Counter(words(raw)).items():
            for b in self[word]:
                seen[b] += n
        at = np.fromiter(seen, np.int64, len(seen))
        value = np.log1p(np.fromiter(seen.values(), np.float64, len(seen)))
        return at, value / max(1e-12, math.sqrt(float(value @ value)))


class Rows:
    """Sparse rows, and the same by bucket once that is asked for."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(vectors)
        self.at = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        self.value = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        self.row = np.repeat(np.arange(self.n), [len(v[0]) for v in vectors])
        self.by_row = self.by_bucket = None

    @staticmethod
    def sums(values: np.ndarray, keys: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
        """Of values that are sorted by key: (where each key begins, the keys)."""
        out = np.zeros(size)
        if len(values):
            out[keys[1]] = np.add.reduceat(values, keys[0])
        return out

    @staticmethod
    def begins(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        return first, keys[first]

    def dot(self, w: np.ndarray) -> np.ndarray:
        if self.by_row is None:
            self.by_row = self.begins(self.row)
        return self.sums(w[self.at] * self.value, self.by_row, self.n)

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        if self.by_bucket is None:
            order = np.argsort(self.at, kind="stable")
            self.by_bucket = self.row[order], self.value[order], self.begins(self.at[order])
        row, value, keys = self.by_bucket
        return self.sums(r[row] * value, keys, size)

    def like(self, at: np.ndarray, value: np.ndarray, row: np.ndarray) -> Rows:
        out = Rows([])
        out.n, out.at, out.value, out.row = self.n, at, value, row
        return out

    def only(self, known: np.ndarray) -> Rows:
        keep = known[self.at]
        return self.like(self.at[keep], self.value[keep], self.row[keep])

    def share(self, use: np.ndarray, size: int) -> np.ndarray:
        """In how many of these rows each bucket is."""
        return np.bincount(self.at, use[self.row].astype(float), size)

    def scaled(self, by: np.ndarray) -> Rows:
        """Values times their buckets' scale, and rows no longer than 1: long ones almost that, short ones little changed."""
        value = self.value * by[self.at]
        return self.like(self.at, value / np.sqrt(0.1 + np.bincount(self.row, value * value, self.n))[self.row], self.row)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Link:
    """A logistic regression on buckets and earlier probabilities."""

    def __init__(self, buckets: int, earlier: int):
        self.w, self.u, self.b, self.constant = np.zeros(buckets), np.zeros(earlier), 0.0, None
        self.ratio, self.moved = np.ones(buckets), math.inf

    def fit(self, rows: Rows, early: np.ndarray, y: np.ndarray, use: np.ndarray, known: np.ndarray, decay: float, steps: int, tolerance: float = 0.0) -> Link:
        """On the rows where ``use``, and only buckets that are ``known``; accelerated gradient descent, until no weight moves by ``tolerance``."""
        n, good = int(use.sum()), float(y[use].sum())
        if not n or good in (0.0, float(n)):
            self.constant = (good + 0.5) / (n + 1.0)
            return self
        with_it = rows.share(use & (y > 0), len(self.w)), rows.share(use & (y == 0), len(self.w))
        self.ratio = known * np.log((with_it[0] + 1) / (good + 2) / (with_it[1] + 1) * (n - good + 2))
        weight = np.where(use, np.where(y > 0, 0.5 * n / good, 0.5 * n / (n - good)), 0.0) / n
        look = [self.w.copy(), self.u.copy(), self.b]
        rows, rate, t = rows.scaled(self.ratio), 4.0 / (2.0 + early.shape[1]), 1.0
        for _ in range(steps):
            if self.moved < tolerance:
                break
            r = weight * (sigmoid(rows.dot(look[0]) + early @ look[1] + look[2]) - y)
            new = [
                look[0] - rate * (rows.back(r, len(self.w)) + decay * look[0]),
                look[1] - rate * (early.T @ r + decay * look[1]),
                look[2] - rate * float(r.sum()),
            ]
            t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
            look = [a + (before - 1) / t * (a - b) for a, b in zip(new, (self.w, self.u, self.b), strict=True)]
            self.moved = max(float(np.abs(a - b).max(initial=0)) for a, b in zip(new, (self.w, self.u, self.b), strict=True))
            self.w, self.u, self.b = new
        return self

    def predict(self, rows: Rows, early: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(rows.n, self.constant)
        return sigmoid(rows.scaled(self.ratio).dot(self.w) + early @ self.u + self.b)


class Chain:
    def __init__(self, names: tuple[str, ...], buckets: int):
        self.names, self.buckets, self.links = names, buckets, []

    def fit(self, rows: Rows, labels: np.ndarray, folds: int = 4, least: int = 3, decay: float = 1e-4, steps: int = 120, tolerance: float = 1e-3) -> Chain:
        """``labels`` has a column for each category; NaN is unknown. Folds are dealt out by position."""
        fold, early = np.arange(rows.n) % folds, np.zeros((rows.n, 0))
        known = np.bincount(rows.at, minlength=self.buckets) >= least
        rows = rows.only(known)
        for k in range(len(self.names)):
            y, has = np.nan_to_num(labels[:, k]), ~np.isnan(labels[:, k])
            out = np.zeros(rows.n)
            for f in range(folds):
                link = Link(self.buckets, k).fit(rows, early, y, has & (fold != f), known, decay, steps, tolerance)
                out[fold == f] = link.predict(rows, early)[fold == f]
            self.links.append(Link(self.buckets, k).fit(rows, early, y, has, known, decay, steps, tolerance))
            early = np.c_[early, out]
        self.out_of_fold = early
        return self

    def predict(self, rows: Rows) -> np.ndarray:
        early = np.zeros((rows.n, 0))
        for link in self.links:
            early = np.c_[early, link.predict(rows, early)]
        return early


def threshold(p: np.ndarray, y: np.ndarray, most_false: float) -> float:
    """The lowest that lets at most this share of the negatives over it."""
    clean = np.sort(p[y == 0])
    if not len(clean) or not (y == 1).any():
        return 1.0
    at = max(0, math.ceil(len(clean) * (1 - most_false)) - 1)
    return float(max(0.5, clean[at]))


def labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, categories: tuple[tuple[str, str, object], ...], most: int, buckets: int) -> tuple[list, list]:
    """Vectors and labels of the chosen texts, by hash of id."""
    judged = [F.max((F.col(c) == F.lit(means)).cast("double")).alias(f"y{k}") for k, (_, c, means) in enumerate(categories)]
    known = labels.where(F.col(id).isNotNull() & F.col(categories[-1][1]).isNotNull()).groupBy(F.col(id).alias("id")).agg(*judged)
    # `most_labels` rows at most: its size doesn't follow the data.
    some = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(most))
    joined = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(some, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Buckets(buckets)
        for b in slices(batches, 1):
            vectors = [features.vector(raw) for raw in raw_texts(b.column(1))]
            at, value = ([v[k].astype(t).tobytes() for v in vectors] for k, t in ((0, np.int32), (1, np.float32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.binary()), pa.array(value, pa.binary()), *b.columns[2:]], names=["id", "at", "value", *b.schema.names[2:]])

    kind = joined.schema["id"].dataType.simpleString()
    found = joined.mapInArrow(run, f"id {kind}, at binary, value binary, {', '.join(f'y{k} double' for k in range(len(categories)))}")
    rows = found.withColumn("h", F.xxhash64("id")).orderBy("h", "id", "at", "value").limit(most).collect()
    y = [[math.nan if r[f"y{k}"] is None else r[f"y{k}"] for k in range(len(categories))] for r in rows]
    return [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(np.float64)) for r in rows], y


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", categories: tuple[tuple[str, str, object], ...] = CATEGORIES, buckets: int = 1 << 16, most_labels: int = 4000, most_false: float = 0.002, **options) -> DataFrame:
    """(id, p_<category> of the chain, toxic) for every row of ``docs``.

    ``toxic`` is whether the last category's probability is over the threshold that, of the out-of-fold probabilities, at most
    ``most_false`` of the texts labelled clean exceed.
    """
    vectors, y = labelled(docs, labels, id, text, categories, most_labels, buckets)
    names_of = tuple(c for c, _, _ in categories)
    chain, known = Chain(names_of, buckets), np.array(y, float).reshape(-1, len(categories))
    chain.fit(Rows(vectors), known, **options)
    cut = threshold(chain.out_of_fold[:, -1], known[:, -1], most_false) if len(known) else 1.0
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    base = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, features = sent.value, Buckets(buckets)
        for b in slices(batches, 1):
            p = chain.predict(Rows([features.vector(raw) for raw in raw_texts(b.column(1))]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k], pa.float64()) for k in range(len(names_of))), pa.array(p[:, -1] > cut)], names=names)

    schema = base.select("id", *(F.lit(0.0).alias(f"p_{c}") for c in names_of), F.lit(True).alias("toxic")).schema
    names = schema.names
    return base.mapInArrow(run, schema).withColumnRenamed("id", id)
