"""Toxicity by classifier chains.

The categories form a chain: insult, contempt, toxic. A linear model per category sees word counts and the probabilities
of the earlier categories. While fitting, those probabilities come from models that did not see the row (out of fold);
models fitted to all rows predict. ``labels.toxic`` is the only label given, so the two earlier categories are
weak labels: the document is toxic and has a word of the category's family. Families are an argument; a category without
a positive row is reported by a warning, as the chain then says nothing about it.

Features are the counts of all words and of all beginnings of words, hashed into ``CELLS`` columns; no feature has to pass a
hurdle, however few labels there are. A ridge penalty that is weaker where presence tells the classes apart does the
selection. Fitting takes at most ``SAMPLE`` labelled documents: all of the rarer class (up to half of SAMPLE), the others of
the lowest id hash, weighted so that the classes keep their shares. What the driver holds is bounded by SAMPLE and CELLS: eight
bytes, and about four times that while fitting, for each column that occurs in each of these documents, and one weight
for each column and category. Every document is then scored on its whole text, in one pass without a shuffle; the table
of weights (CELLS floats a category) is broadcast.

Defined results: a null or empty text scores as a text without feature words; label rows with a null in id or label are
not used, several labels of one id count as the highest; with no usable label, or usable labels of one class only, nothing
is toxic and a warning says so; other columns are kept, and columns of the added names give way.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalake.llm.linear import SparseRows, fit_sparse, folds_of, sigmoid
from catalake.llm.shared import written
from catalake.llm.wordsets import slices

SAMPLE = 6_000
#: Columns that features are hashed into.
CELLS = 1 << 20
#: Lengths of word beginnings that serve as features, and the mark of a whole word.
STEMS = (4, 5, 6)
WHOLE = "$"
FOLDS = 5
PENALTY = 0.1
THRESHOLD = 0.5
# The word families of the two weak categories, where the caller gives no others.
FAMILIES = {
    "insult": ("idiot", "moron", "loser", "clown", "stupid", "fool"),
    "contempt": ("pathetic", "worthless", "disgusting", "trash", "scum", "garbage"),
}
CHAIN = (*FAMILIES, "toxic")
_WORD = re.compile(r"[^\W\d_]+")


class Words(dict):
    """Numbers of the words of some texts, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many distinct words each text has, their numbers, and the logarithms of one more than their counts."""
        sizes, numbers, times = [], [], []
        for text in texts:
            found = Counter(_WORD.findall((text or "").lower()))
            sizes.append(len(found))
            numbers.extend([self[w] for w in found])
            times.extend(found.values())
        return np.array(sizes, np.int64), np.array(numbers, np.int64), np.log1p(np.array(times, np.float64))

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """How many features each word has, and their columns."""
        units = [[zlib.crc32((w + WHOLE).encode()), *[zlib.crc32(w[:n].encode()) for n in STEMS if len(w) > n]] for w in self]
        return np.array([len(u) for u in units], np.int64), np.array([h % CELLS for u in units for h in u], np.int32)


def unit_counts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the columns of its features in order, and their counts (sums over words, on a log scale)."""
    words = Words()
    sizes, numbers, times = words.of(texts)
    many, columns = words.units()
    starts = np.cumsum(many) - many
    out, at = [], 0
    for size in sizes.tolist():
        here, count = numbers[at : at + size], times[at : at + size]
        runs = many[here]
        places = np.repeat(starts[here] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        cells, where = np.unique(columns[places], return_inverse=True)
        out.append((cells, np.bincount(where, np.repeat(count, runs), len(cells)).astype(np.float32)))
        at += size
    return out


def counter(words: list[str]):
    """A function from texts to counts of feature words, one column each."""
    machine = ahocorasick.Automaton()
    for place, word in enumerate(words):
        stem = word.rstrip(WHOLE)
        machine.add_word(stem, (place, len(stem), word.endswith(WHOLE)))
    if words:
        machine.make_automaton()

    def counts(texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(words)))
        for row, text in enumerate(texts if words else ()):
            low = (text or "").lower()
            for last, (place, size, whole) in machine.iter(low):
                before, after = low[last - size : last - size + 1] if last >= size else "", low[last + 1 : last + 2]
                if not before.isalpha() and not (whole and after.isalpha()):
                    out[row, place] += 1
        return out

    return counts


def fit_chain(
    counts: np.ndarray | SparseRows, targets: np.ndarray, ids: np.ndarray, weight: np.ndarray | None = None
) -> list[np.ndarray]:
    """One weight vector per category (constant, features); later ones also weigh the earlier categories' probabilities."""
    folds, x, models = folds_of(ids, FOLDS), SparseRows.of(counts), []
    weight = np.ones(len(ids)) if weight is None else weight
    earlier = np.zeros((len(ids), 0))
    for place in range(targets.shape[1]):
        y = targets[:, place]
        models.append(fit_sparse(x, earlier, y, weight, PENALTY))
        if place + 1 == targets.shape[1]:
            break
        unseen = np.zeros(len(ids))
        for fold in range(FOLDS):
            out = folds == fold
            if out.any():
                w = fit_sparse(x, earlier, y, weight * ~out, PENALTY, models[-1])
                unseen[out] = sigmoid(_margins(w, x) + earlier @ w[x.shape[1] + 1 :])[out]
        earlier = np.concatenate([earlier, unseen[:, None]], axis=1)
    return models


def _margins(w: np.ndarray, x: SparseRows) -> np.ndarray:
    return w[0] + x.times(w[1 : x.shape[1] + 1])


def _chained(margins: list[np.ndarray], tails: list[np.ndarray]) -> np.ndarray:
    """Probabilities from what the features say and the weights of the earlier categories' probabilities."""
    found = np.zeros((len(margins[0]), 0))
    for margin, tail in zip(margins, tails, strict=True):
        found = np.concatenate([found, sigmoid(margin + found @ tail)[:, None]], axis=1)
    return found


def chain_scores(models: list[np.ndarray], counts: np.ndarray | SparseRows) -> np.ndarray:
    """Probability of every category, in chain order."""
    x = SparseRows.of(counts)
    return _chained([_margins(w, x) for w in models], [w[x.shape[1] + 1 :] for w in models])


def _labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The documents to fit to, and how many usable labels each class has."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna().filter("toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
        .join(docs.select(F.col("doc_id").cast("long").alias("id")), "id", "left_semi")
    )
    known = written(known, "known")
    of = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rare = int(of[1] <= of[0])
    taken = min(of[rare], SAMPLE // 2)
    lowest = lambda c, n: known.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(n)
    # at most SAMPLE rows of 12 bytes: small enough to send to every task
    chosen = lowest(rare, taken).union(lowest(1 - rare, SAMPLE - taken))
    sample = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    return written(sample, "labelled"), of


def fit(docs: DataFrame, labels: DataFrame, families: dict[str, tuple[str, ...]] = FAMILIES) -> tuple[np.ndarray, list[np.ndarray]]:
    """Columns of the features in order, and the models of the chain; none without labels of both classes."""
    sample, of = _labelled(docs, labels)
    if not of[0] or not of[1]:
        warnings.warn(f"no toxicity model: {of[1]} toxic and {of[0]} other labelled documents", stacklevel=3)
        return np.zeros(0, np.int32), []

    def count(batches):
        counters = [counter([w + WHOLE for w in words]) for words in families.values()]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            units = unit_counts(texts)
            weak = np.stack([f(texts).sum(axis=1) > 0 for f in counters], axis=1)
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(weak.tolist(), pa.list_(pa.bool_())),
                 pa.array([c.tobytes() for c, _ in units], pa.binary()), pa.array([v.tobytes() for _, v in units], pa.binary())],
                names=["id", "toxic", "weak", "cells", "counts"],
            )

    counted = sample.select("id", "text", "toxic").mapInArrow(
        count, "id long, toxic int, weak array<boolean>, cells binary, counts binary"
    )
    # bounded: SAMPLE labelled ids (several rows only where ids repeat)
    rows = sorted(written(counted, "units").toLocalIterator(), key=lambda r: (r["id"], r["cells"], r["counts"]))
    ids = np.array([r["id"] for r in rows], np.int64)
    toxic = np.array([r["toxic"] for r in rows], float)
    weak = np.array([r["weak"] for r in rows], float).reshape(len(rows), -1)
    sizes = np.array([len(r["cells"]) // 4 for r in rows], np.int64)
    cells = np.frombuffer(b"".join(r["cells"] for r in rows), np.int32)
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.float32)
    del rows
    known = np.unique(cells)
    columns = np.searchsorted(known, cells).astype(np.int32)
    del cells
    x = SparseRows(sizes, columns, counts, len(known))
    del columns, counts
    weak = weak * toxic[:, None]
    for name, found in zip(families, weak.sum(axis=0), strict=True):
        if not found:
            warnings.warn(f"category {name} has no positive row: no toxic document holds one of its words", stacklevel=3)
    share = np.array([of[0], of[1]]) / (of[0] + of[1])
    weight = np.where(toxic > 0, share[1] / toxic.mean(), share[0] / (1 - toxic).mean())
    return known, fit_chain(x, np.concatenate([weak, toxic[:, None]], axis=1), ids, weight)


ADDED = tuple(f"p_{name}" for name in CHAIN)


def score(docs: DataFrame, labels: DataFrame, families: dict[str, tuple[str, ...]] = FAMILIES) -> DataFrame:
    """``docs`` with a probability for each category of the chain: ``families`` (name: lower-case words), then toxic."""
    known, models = fit(docs, labels, families)
    new = [f"p_{name}" for name in (*families, "toxic")]
    names = [c for c in docs.columns if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    if not models:
        return rows.select("*", *[F.lit(0.0).alias(c) for c in new])
    width = len(known)
    first, tails = [w[0] for w in models], [w[width + 1 :] for w in models]
    weights = np.zeros((CELLS, len(models)), np.float32)
    weights[known] = np.stack([w[1 : width + 1] for w in models], axis=1)
    # CELLS floats a category, whatever the input
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def margins(texts: list[str | None]) -> list[np.ndarray]:
        words = Words()
        sizes, numbers, times = words.of(texts)
        many, columns = words.units()
        says = sent.value[columns]
        x = SparseRows(sizes, numbers, times, len(words))
        unit_of = np.repeat(np.arange(len(words)), many)
        return [first[i] + x.times(np.bincount(unit_of, says[:, i], len(words))) for i in range(len(models))]

    def predict(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = slices(batch.column(batch.schema.get_field_index("text")))
            found = np.concatenate([_chained(margins(part.to_pylist()), tails) for part in parts])
            yield pa.record_batch(
                [*batch.columns, *[pa.array(found[:, i]) for i in range(len(new))]],
                names=[*batch.schema.names, *new],
            )

    added = [T.StructField(c, T.DoubleType()) for c in new]
    return rows.mapInArrow(predict, T.StructType([*rows.schema.fields, *added]))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the last category of the chain does not reject."""
    return score(docs, labels).filter(F.col(ADDED[-1]) < threshold).drop(*ADDED)
