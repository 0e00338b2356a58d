"""Toxicity: a logistic classifier on words, regularised by counterfactuals.

Features of a document are its distinct words and their prefixes of ``PREFIXES`` letters. Counts over
the labelled rows choose the features whose rates differ clearly between the labels. The fit
minimises the log loss plus a penalty on the square of the change of a labelled document's score
under its counterfactual: each identity term is swapped for another of its kind; a document that
names no group gets a mention of one, chosen by a hash of its text. So a group's name, and the
prefixes it shares with other words, can't carry a score. Loss and gradient are summed by Spark, one
small job an evaluation; the driver holds the weights only.

Documented bound: at most about ``MAX_FIT_ROWS`` labelled rows are fitted, chosen by a hash of their
id and, where rows share ids, of their text too (rows that repeat count once there); the features, all from these rows, are
bounded by them. ``Model.converged`` says whether the fit reached its tolerance within ``ROUNDS``. Every document is scored,
on its whole text.

Defined cases: a null or empty text gets the score of no words; rows without a label of 0 or 1 don't
teach, of repeated labels the greatest holds; without both labels the score is the share of label 1
(0 without any); a null doc_id is not held out; repeated rows are scored each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempera.llm.common import mapped, written

MAX_FIT_ROWS = 100_000
MIN_ROWS, MIN_G = 4, 12.25  # of a feature: labelled rows with it, log-likelihood ratio
PREFIXES = (4, 5)
L2, COUNTERFACTUAL = 1e-4, 1.0
ROUNDS, TOLERANCE = 20, 1e-4  # of the fit; its loss falls by less than this share of it at the end
HELD_OUT = 2  # remainder of crc32(doc_id) by 4
THRESHOLD = 0.3

#: Identity terms by kind; a swap stays within a kind.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"), ("immigrants", "refugees", "natives", "foreigners"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"),
    ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_SWAP = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, t in enumerate(kind)}
_TERMS = sorted(_SWAP)
_WORD = re.compile(r"\w+")
_COUNTED = 300_000  # features a task counts before it passes the counts on


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _features(words: Iterable[str], keep: set[str] | None = None) -> set[str]:
    """The words and their prefixes (marked by ^), of these only those to ``keep``."""
    every = [set(words), *[{f"^{w[:k]}" for w in words if len(w) > k} for k in PREFIXES]]
    return set().union(*[x if keep is None else x & keep for x in every])


def _counterfactual(words: set[str], text: str | None) -> set[str]:
    """The words with each identity term swapped, or with a mention of one if they name none."""
    named = words & _SWAP.keys()
    if named:
        return (words - named) | {_SWAP[w] for w in named}
    return words | {_TERMS[zlib.crc32((text or "").encode()) % len(_TERMS)]}


@dataclass
class Model:
    bias: float = 0.0  # in logits
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    features: dict[str, int] = field(default_factory=dict)
    converged: bool = True
    loss: float = 0.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Texts and labels to learn from; the labels are a bounded sample, small enough to broadcast."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * 0.98 * max_rows / n))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label")


def _chosen(rows: DataFrame, n_pos: int, n_neg: int) -> list[str]:
    """Features with clearly different odds; counts are combined in the tasks, then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()

        def record() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([counts[v][f] for f in names], pa.int64()) for v in (1, 0)]], ["f", "p", "n"])

        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
                counts[label].update(_features(_words(text.as_py())))
                if len(counts[0]) + len(counts[1]) > _COUNTED:
                    yield record()
                    counts = Counter(), Counter()
        yield record()

    sums = mapped(rows, count, "f string, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, n, share = F.col("p"), F.col("n"), n_pos / (n_pos + n_neg)
    part = lambda k, of: F.when(k > 0, k * F.log(k / ((p + n) * of))).otherwise(0.0)
    good = sums.where(p + n >= MIN_ROWS).where(2 * (part(p, share) + part(n, 1 - share)) >= MIN_G)
    return sorted(r["f"] for r in good.select("f").collect())


def _lbfgs(loss, x: np.ndarray, rounds: int = ROUNDS, memory: int = 6, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float, bool]:
    """Minimise a smooth convex function given with its gradient: where, its value there, and whether it settled."""
    value, grad = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = -grad, []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            d = d - a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        t = 1.0 if steps else 1.0 / max(1.0, np.abs(grad).sum())
        while True:
            new_value, new_grad = loss(x + t * d)
            if new_value <= value + 1e-4 * t * (grad @ d) or t < 1e-6:
                break
            t /= 4
        s, y = t * d, new_grad - grad
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y)]
        done = abs(value - new_value) < tolerance * max(value, 1e-3)
        x, value, grad = x + s, new_value, new_grad
        if done:
            return x, value, True
    return x, value, False


def fit(docs: DataFrame, labels: DataFrame, counterfactual: float = COUNTERFACTUAL, max_rows: int = MAX_FIT_ROWS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Model:
    """Learn from ``labels`` (doc_id, toxic), but for the rows held out."""
    rows = written(_labelled(docs, labels, max_rows).hint("rebalance"), "labelled")
    n = rows.count()
    if n > max_rows:  # rows that share ids
        rows = rows.distinct().where(F.pmod(F.xxhash64("text", "label"), F.lit(1 << 30)) < int((1 << 30) * 0.98 * max_rows / n))
        rows = written(rows, "labelled")
    by = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_pos, n_neg = by.get(1, 0), by.get(0, 0)
    total = n_pos + n_neg
    if not n_pos or not n_neg:
        share = n_pos / total if total else 0.0
        return Model(40.0 * (2 * share - 1))
    features = {f: i for i, f in enumerate(_chosen(rows, n_pos, n_neg))}
    size = len(features)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, kind = set(features), pa.list_(pa.int64())
        for batch in batches:
            out: list[list[list[int]]] = [[], [], []]
            for text in batch.column("text").to_pylist():
                words = _words(text)
                x, other = _features(words, keep), _features(_counterfactual(words, text), keep)
                for column, found in zip(out, (x, x - other, other - x), strict=True):
                    column.append(sorted(features[f] for f in found))
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), *[pa.array(c, kind) for c in out]], ["label", "x", "lost", "gained"])

    kind = "label int, x array<long>, lost array<long>, gained array<long>"
    vectors = written(mapped(rows, read, kind), "toxicity-vectors")

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy()), column.flatten().to_numpy()

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, grad = 0.0, np.zeros(size + 1)
            for batch in batches:
                y, n = batch.column("label").to_numpy(), batch.num_rows
                (row, at), (row1, lost), (row2, gained) = (flat(batch.column(c)) for c in ("x", "lost", "gained"))
                s = np.bincount(row, w[at], n) + w[-1]
                value += float(np.logaddexp(0, np.where(y == 1, -s, s)).sum())
                g = 1 / (1 + np.exp(-s)) - y
                change = (np.bincount(row2, w[gained], n) - np.bincount(row1, w[lost], n)).astype(float)  # whole numbers if empty
                value += counterfactual * float(change @ change)
                change *= 2 * counterfactual
                grad[:-1] += np.bincount(at, g[row], size) + np.bincount(gained, change[row2], size) - np.bincount(lost, change[row1], size)
                grad[-1] += g.sum()
            yield pa.RecordBatch.from_arrays([pa.array([0] * (size + 2)), pa.array(np.arange(size + 2)), pa.array(np.r_[grad, value])], ["z", "i", "g"])

        sums = mapped(vectors, partial, "z long, i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
        out = np.zeros(size + 2)
        for r in sums:
            out[r["i"]] = r["g"]
        w0 = np.r_[w[:-1], 0]
        return out[-1] / total + L2 / 2 * (w0 @ w0), out[:-1] / total + L2 * w0

    w, least, settled = _lbfgs(loss, np.r_[np.zeros(size), np.log(n_pos / n_neg)], rounds, tolerance=tolerance)
    return Model(float(w[-1]), w[:-1], features, settled, least)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = set(model.features)
        for batch in batches:
            found = [sorted(model.features[f] for f in _features(_words(t.as_py()), keep)) for t in batch.column("text")]
            logit = np.array([model.bias + model.weights[x].sum() for x in found], float)
            value = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value, pa.float64())], ["doc_id", "score"])

    scored = mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
