"""Spelling variants: words at one edit from each other, found by blocked Gram matrices.

Words are the maximal runs of ``A-Z a-z`` and U+00C0 to U+00FF of all texts, A-Z lower-cased; one in ``NOISE`` occurrences
loses a letter (by a checksum of id and word). Words of at least ``LONG`` letters that occur at least ``OFTEN`` times count.
Two words are near if one inserted, deleted or replaced letter leads from one to the other.

A word's letter counts form a vector. One edit changes it by a squared distance of at most two. Words are dealt to blocks by
how many of their letters fall into each of ``GROUPS`` classes of letters, and so by length. A block meets itself and those
blocks that one edit can lead to: a letter more in one class, or one class up and another down. Each pair of blocks meets
once. In a task the letter counts of a block and of the words that it meets are multiplied; the Gram matrix gives all squared
distances at once, and pairs at a distance of at most two are compared letter by letter.

Blocks of more than ``TILE`` bytes are dealt over several tasks by a hash of the word, and the words they meet go to each of
them. A task holds one tile and a batch of words, whatever the size of a block. The words counted grow more slowly than the
texts; the products grow with the square of a block, of which there are thousands for each length.

A word's form is its near word of largest count, if that is at least ``TIMES`` times its own; its root is where the chain of
forms ends. Counts at least double along a chain, so a number of pointer doublings that follows from the largest count is
enough.

Defined results: a null text has no words, a null id counts as an empty one in the checksum; repeated rows and ids count each
time; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalake.llm.shared import written
from catalake.llm.streams import segments

NOISE = 97
LONG = 5
OFTEN = 3
TIMES = 2
GROUPS = 6
TILE = 1 << 21
_LETTERS = [*range(97, 123), *range(0xC0, 0x100)]
_COLUMN = np.zeros(256, np.int64)
_COLUMN[_LETTERS] = np.arange(len(_LETTERS))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the right side that are multiplied at once, and letters that are compared at once.
_SLICE = 1 << 10
_COMPARED = 1 << 22
#: Counts below this have exact products in single precision.
_EXACT = 2_000


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that count."""
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower())
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit("([a-zÀ-ÿ]+)"), 1)).alias("run"))
    runs = runs.filter(F.length("run") >= LONG).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.col("h") % NOISE == 0, shorter).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).filter(F.length("word") >= LONG).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= OFTEN)


def _classes(word: Column) -> Column:
    """How many letters of the word fall into each class."""
    members = ["".join(chr(c) for c in _LETTERS if c % GROUPS == g) for g in range(GROUPS)]
    return F.array(*[F.length(word) - F.length(F.translate(word, m, "")) for m in members])


def _met_by(classes: Column) -> Column:
    """The blocks that meet this one as the left side, itself included."""
    def moved(up: int | None, down: int) -> Column:
        return F.array(*[F.get(classes, g) + (1 if g == up else -1 if g == down else 0) for g in range(GROUPS)])

    others = [moved(i, j) for j in range(GROUPS) for i in [None, *range(j)]]
    return F.filter(F.array(classes, *others), lambda c: F.array_min(c) >= 0)


def _dealt(vocabulary: DataFrame) -> DataFrame:
    """(tile, right, own, word, n): every word in its own tile as the left side, and in the tiles of the blocks it meets."""
    blocks = vocabulary.groupBy("classes").agg(F.sum(F.length("word") + 4 * len(_LETTERS)).alias("bytes"))
    blocks = written(blocks.select("classes", F.ceil(F.col("bytes") / TILE).cast("int").alias("tiles")), "blocks")
    met = blocks.select("classes", F.explode(_met_by(F.col("classes"))).alias("left"))
    met = met.join(blocks.select(F.col("classes").alias("left"), "tiles"), "left")
    met = met.groupBy("classes").agg(F.collect_list(F.struct("left", "tiles")).alias("met"))
    known = vocabulary.join(met, "classes")
    name = lambda block, tile: F.concat_ws(":", F.array_join(block.cast("array<string>"), ":"), tile)
    mine = known.join(blocks, "classes").select(
        name(F.col("classes"), F.pmod(F.xxhash64("word"), F.col("tiles"))).alias("tile"), F.lit(False).alias("right"),
        F.lit(True).alias("own"), "word", "n")
    theirs = known.select("classes", "word", "n", F.explode("met").alias("m"))
    theirs = theirs.select("classes", "word", "n", "m.left", F.explode(F.sequence(F.lit(0), F.col("m.tiles") - 1)).alias("t"))
    theirs = theirs.select(name(F.col("left"), F.col("t")).alias("tile"), F.lit(True).alias("right"),
                           (F.col("left") == F.col("classes")).alias("own"), "word", "n")
    return mine.union(theirs).repartition("tile").sortWithinPartitions("tile", "right", "own")


class Block:
    """Words of one length as letters (one byte each), letter counts and squared norms."""

    def __init__(self, column: pa.Array):
        texts = [w.encode("latin-1") for w in column.to_pylist()]
        self.letters = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
        size = self.letters.shape[1]
        cells = np.arange(len(texts))[:, None] * len(_LETTERS) + _COLUMN[self.letters]
        counts = np.bincount(cells.ravel(), minlength=len(texts) * len(_LETTERS)).reshape(len(texts), -1)
        self.counts = counts.astype(np.float32 if size < _EXACT else np.float64)
        self.norms = (self.counts**2).sum(axis=1)


def near_pairs(left: Block, right: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs at one edit; words of ``right`` have as many letters as those of ``left`` or one more."""
    gram = left.counts @ right.counts.T
    gram *= 2
    a, b = np.nonzero(gram >= left.norms[:, None] + right.norms[None, :] - 2)
    size, longer = left.letters.shape[1], right.letters.shape[1] > left.letters.shape[1]
    found = [np.zeros((2, 0), np.int64)]
    step = max(1, _COMPARED // size)
    for begin in range(0, len(a), step):
        i, j = a[begin : begin + step], b[begin : begin + step]
        x, y = left.letters[i], right.letters[j]
        if longer:
            first = np.concatenate([x != y[:, :-1], np.ones((len(i), 1), bool)], axis=1).argmax(axis=1)
            last = np.concatenate([(x != y[:, 1:])[:, ::-1], np.ones((len(i), 1), bool)], axis=1).argmax(axis=1)
            one = first + last >= size
        else:
            one = (x != y).sum(axis=1) == 1
        found.append(np.stack([i[one], j[one]]))
    i, j = np.concatenate(found, axis=1)
    return i, j


def _near(batches):
    """(word, n, other, other_n), in both directions, for all near pairs of tiles of blocks."""
    tile: list[pa.RecordBatch] = []
    left = None
    for _, rows, new in segments(batches, "tile"):
        if new:
            tile, left = [], None
        side = rows.column(1).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(side, True))
        if cut:
            tile.append(rows.slice(0, cut))
        for begin in range(cut, len(side), _SLICE):
            part = rows.slice(begin, _SLICE)
            if left is None:
                mine = pa.Table.from_batches(tile).combine_chunks()
                left = Block(mine["word"])
            # rows of the block itself come last
            own = int(np.searchsorted(part.column(2).to_numpy(zero_copy_only=False), True))
            yield from _found(mine, left, part.slice(0, own), False)
            yield from _found(mine, left, part.slice(own), True)


def _found(mine: pa.Table, left: Block, rows: pa.RecordBatch, own: bool):
    lengths = np.array([len(w) for w in rows.column(3).to_pylist()], np.int64)
    for size in np.unique(lengths).tolist():
        part = rows.take(pa.array(np.flatnonzero(lengths == size)))
        right = Block(part.column(3))
        a, b = near_pairs(left, right)
        if own:
            # each pair of one block once: at the letter that differs, the left word's comes first
            differ = (left.letters[a] != right.letters[b]).argmax(axis=1)
            once = left.letters[a, differ] < right.letters[b, differ]
            a, b = a[once], b[once]
        if len(a):
            one = [mine["word"].take(pa.array(a)).combine_chunks(), mine["n"].take(pa.array(a)).combine_chunks()]
            two = [part.column(3).take(pa.array(b)), part.column(4).take(pa.array(b))]
            for row in (one + two, two + one):
                yield pa.record_batch(row, names=["word", "n", "other", "other_n"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for every word of ``vocabulary`` (word, n) and each of its near words."""
    known = vocabulary.withColumn("classes", _classes(F.col("word")))
    return _dealt(known).mapInArrow(_near, "word string, n long, other string, other_n long")


def _roots(formed: DataFrame, rounds: int) -> DataFrame:
    """(word, root) by pointer doubling."""
    now = written(formed.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        following = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = written(now.join(following, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return now


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that counts."""
    vocabulary = written(words(docs), "words")
    best = near_words(vocabulary).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    has = -F.col("best.less") >= TIMES * F.col("n")
    known = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                  F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "near")
    most = vocabulary.agg(F.max("n")).first()[0] or OFTEN
    longest = max(1, math.ceil(math.log2(most / OFTEN + 1) / math.log2(TIMES)))
    roots = _roots(known.filter("form is not null"), math.ceil(math.log2(longest + 1)))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
