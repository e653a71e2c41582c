"""Document quality by pairwise ranking (Bradley-Terry).

Each document has a few features of its whole text (shares of character classes, word and line statistics). Preference
pairs put a document labelled good before one labelled bad; the logistic loss on feature differences gives the weights,
and the weighted sum is the document's strength. The threshold is a quantile of the strengths of all labelled documents:
the share labelled bad. Strengths are moved and scaled so that this quantile scores ``THRESHOLD``.

Fitting takes every labelled document. Equal features of one label become a row with a count. Rows are dealt into blocks
by hash, some ``RARER`` rows of the rarer label and at most some ``COMMONER`` of the other in a block, and in a block every
good row is compared with every bad one; rows of the rarer label are copied to further blocks where the other has more.
So each row takes part (a block without the rarer label has a chance of e^-64), the work grows with the rows, and a task
holds the blocks of one split. A pair weighs as much as its rows, all pairs together as much as ``PAIRS``. A Newton step is
one pass over the blocks; their sums are whole numbers, so that neither the order nor the number of tasks matters. The
threshold is found exactly, 16 bits of the strength at a time. Texts are read once: features are written and then scored.
Only the text is an input of a score.

Defined results: a null text counts as empty; an empty text has all shares zero and is scored like any other; with only
one label known every score is one half; rows with a null id are scored and count as not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalake.llm.linear import sigmoid
from catalake.llm.shared import written
from catalake.llm.wordsets import pieces, span_hashes, word_hashes

PAIRS = 60_000
RARER = 64
COMMONER = 256
ROUNDS = 30
UNIT = 2.0**40
THRESHOLD = 0.3
PENALTY = 1.0
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "mark", "symbol", "bracket", "other")
FEATURES = (*CLASSES, "log_chars", "log_words", "word_length", "long_words", "distinct_words", "words_per_line",
            "distinct_lines", "stop_per_word", "symbol_per_word", "upper_per_word", "mark_per_word", "digit_per_word")


def _class_of_bytes() -> np.ndarray:
    groups = {
        "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
        "space": b" \t\r\v\f", "line": b"\n", "stop": b".,;:'\"-", "mark": b"!?", "symbol": b"#$%&*|=_~^@+/\\`",
        "bracket": b"()[]{}<>",
    }
    of = np.full(256, CLASSES.index("other"), np.int64)
    for name, members in groups.items():
        of[list(members)] = CLASSES.index(name)
    return of


_CLASS = _class_of_bytes()


def _line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every line and the index of each text's first line."""
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    return span_hashes(data, cuts[:-1], cuts[1:]), np.searchsorted(cuts, offsets)


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(values[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)],
                    dtype=float)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    found = []
    for data, offsets in pieces(column):
        texts = len(offsets) - 1
        size = np.diff(offsets)
        row = np.repeat(np.arange(texts), size)
        classes = np.bincount(row * len(CLASSES) + _CLASS[data], minlength=texts * len(CLASSES)).reshape(texts, -1)
        words, first = word_hashes(data, offsets)
        lines, first_line = _line_hashes(data, offsets)
        n, chars = np.maximum(np.diff(first), 1).astype(float), np.maximum(size, 1).astype(float)
        n_lines = np.maximum(np.diff(first_line), 1).astype(float)
        by = {name: classes[:, i].astype(float) for i, name in enumerate(CLASSES)}
        solid = chars - by["space"] - by["line"]
        found.append(
            np.stack(
                [
                    *[by[name] / chars for name in CLASSES],
                    np.log1p(size), np.log1p(np.diff(first)), solid / n, np.maximum(solid / n - 7, 0),
                    _distinct(words, first) / n, np.log1p(n / n_lines), _distinct(lines, first_line) / n_lines,
                    by["stop"] / n, np.minimum(by["symbol"] / n, 3), np.minimum(by["upper"] / n, 3),
                    np.minimum(by["mark"] / n, 3), np.minimum(by["digit"] / n, 3),
                ],
                axis=1,
            )
        )
    return np.concatenate(found) if found else np.zeros((0, len(FEATURES)))


class Ranking:
    """Weights of the standardised features, and the move and scale of the score."""

    def __init__(self, middle: np.ndarray, spread: np.ndarray):
        self.middle, self.spread = middle, spread
        self.weights, self.cut, self.slope = np.zeros(len(FEATURES)), 0.0, 0.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.spread, -6, 6)

    def strength(self, x: np.ndarray) -> np.ndarray:
        # one sum a row, in the order of the features, so that it does not depend on the rows beside it
        return (self.inputs(x) * self.weights).cumsum(axis=1)[:, -1]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), 0.5)
        at_cut = np.log(THRESHOLD / (1 - THRESHOLD))
        return sigmoid(self.slope * (self.strength(x) - self.cut) + at_cut)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _lists(x: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(x.ravel()))


def measured(docs: DataFrame) -> DataFrame:
    """(id, x) for every document, written once."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), _lists(features(batch.column(1)))], names=["id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return written(rows.mapInArrow(run, "id long, x array<double>"), "features")


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every feature; decimals, as sums of doubles depend on their order."""
    places = range(len(FEATURES))

    def mean(of):
        sums = [F.sum((of(F.get("x", F.lit(i)), i) * F.col("n")).cast("decimal(38,9)")).cast("double") for i in places]
        total, *found = rows.agg(F.sum("n"), *sums).first()
        return np.array(found, dtype=float) / total

    middle = mean(lambda x, i: x)
    return middle, np.sqrt(mean(lambda x, i: (x - float(middle[i])) * (x - float(middle[i])))) + 1e-6


def _blocks(rows: DataFrame, rarer: int, n_rarer: int, n_commoner: int) -> DataFrame:
    """(rows) of every block: label, features and count, in an order of their own."""
    blocks = max(1, n_rarer // RARER)
    parts = max(1, -(-n_commoner // (blocks * COMMONER)))
    one = F.array(F.pmod(F.xxhash64("x", F.lit("part")), F.lit(parts)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    dealt = rows.select(
        F.pmod(F.xxhash64("x"), F.lit(blocks)).alias("block"), F.explode(F.when(F.col("good") == rarer, every).otherwise(one)).alias("part"),
        F.struct("good", "x", "n").alias("row"),
    )
    return written(dealt.groupBy("block", "part").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("rows"), "blocks")


def _step(model: Ranking, good: np.ndarray, z: np.ndarray, n: np.ndarray, rarer: int) -> np.ndarray | None:
    """Slope and bend of the loss of one block, in one vector."""
    a, b = z[good], z[~good]
    if not len(a) or not len(b):
        return None
    weight = n[good][:, None] * n[~good] / n[good == bool(rarer)].sum()
    off = sigmoid((b @ model.weights) - (a @ model.weights)[:, None])
    first = weight * off
    second = first * (1 - off)
    crossed = a.T @ second @ b
    slope = first.sum(axis=0) @ b - first.sum(axis=1) @ a
    bend = (a.T * second.sum(axis=1)) @ a + (b.T * second.sum(axis=0)) @ b - crossed - crossed.T
    return np.concatenate([slope, bend.ravel()])


def _newton(model: Ranking, blocks: DataFrame, rarer: int, weight: float) -> None:
    """Sets the weights; ``weight``: of all pairs before they are scaled to ``PAIRS``."""
    width = len(FEATURES)

    def run(batches):
        total = np.zeros(width + width * width, dtype=np.int64)
        for batch in batches:
            lists = batch.column(0)
            row = lists.flatten()
            good = row.field("good").to_numpy(zero_copy_only=False) == 1
            n = row.field("n").to_numpy(zero_copy_only=False).astype(float)
            z = model.inputs(_matrix(row.field("x")))
            ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                found = _step(model, good[a:b], z[a:b], n[a:b], rarer)
                if found is not None:
                    total += np.rint(found * (PAIRS / weight * UNIT)).astype(np.int64)
        yield pa.record_batch([_lists(total[None, :])], names=["sums"])

    for _ in range(ROUNDS):
        # a row of fixed size for each task; whole numbers
        sums = [r["sums"] for r in blocks.mapInArrow(run, "sums array<long>").toLocalIterator()]
        total = np.array([sum(column) for column in zip(*sums, strict=True)], dtype=float) / UNIT
        slope = total[:width] + PENALTY * model.weights
        step = np.linalg.solve(total[width:].reshape(width, width) + PENALTY * np.eye(width), slope)
        model.weights = model.weights - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break


def _ordered(keys: np.ndarray) -> np.ndarray:
    """Bits of doubles as whole numbers of the same order; its own inverse on the bits."""
    return keys ^ ((keys >> 63) & np.int64(2**63 - 1))


def _value_at(keys: DataFrame, rank: int) -> float:
    """The value of this rank (from 0) among (key, n); at most 2^16 counts a pass reach the driver."""
    found = None
    for shift in (48, 32, 16, 0):
        rows = keys if found is None else keys.where(F.shiftright("key", shift + 16) == found)
        counts = rows.groupBy(F.shiftright("key", shift).alias("bits")).agg(F.sum("n").alias("n")).collect()
        for bits, n in sorted((r["bits"], r["n"]) for r in counts):
            found = bits
            if rank < n:
                break
            rank -= n
    return float(_ordered(np.array([found], dtype=np.int64)).view(np.float64)[0])


def _quantile(model: Ranking, rows: DataFrame, total: int, share: float) -> float:
    """Exact quantile of the strengths of all rows, linear between neighbours."""

    def run(batches):
        for batch in batches:
            bits = (model.strength(_matrix(batch.column(0))) + 0.0).view(np.int64)  # no negative zeros
            yield pa.record_batch([pa.array(_ordered(bits)), batch.column(1)], names=["key", "n"])

    keys = written(rows.select("x", "n").mapInArrow(run, "key long, n long"), "strengths")
    place = (total - 1) * share
    low = int(place)
    below, above = _value_at(keys, low), _value_at(keys, min(low + 1, total - 1))
    return below + (above - below) * (place - low)


def fit(found: DataFrame, labels: DataFrame) -> Ranking:
    """The model of all labelled documents outside the held-out fold; ``found``: see ``measured``."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("good"))
        .dropna().filter("good in (0, 1)").filter(F.crc32(F.col("id").cast("string")) % 5 != 0)
        .groupBy("id").agg(F.min("good").alias("good"))
    )
    rows = written(found.join(known, "id").groupBy("good", "x").agg(F.count(F.lit(1)).alias("n")), "labelled")
    # at most two rows
    sizes = {r["good"]: (r["rows"], r["n"]) for r in rows.groupBy("good").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
    if len(sizes) < 2:
        return Ranking(np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    rarer = min(sizes, key=lambda good: (sizes[good][0], good))
    model = Ranking(*_moments(rows))
    _newton(model, _blocks(rows, rarer, sizes[rarer][0], sizes[1 - rarer][0]), rarer, sizes[1 - rarer][1])
    total = sizes[0][1] + sizes[1][1]
    model.cut = _quantile(model, rows, total, 1 - sizes[1][1] / total)
    model.slope = 1.0
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, held_out, score, predicted) for every document."""
    rows = measured(docs)
    model = fit(rows, labels)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["id", "score"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    return rows.mapInArrow(run, schema).select(
        "id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
