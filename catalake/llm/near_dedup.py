"""MinHash near-duplicate groups by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so a signature of s
values costs s/2 permutations. Values are banded; documents that agree in a whole band are candidates. Candidates whose
signatures agree far too rarely are passed over, the rest are confirmed on their full shingle sets.

Groups are built without emitting all pairs of a bucket: documents of equal sets are one class from the start, and every
class is first tied to the smallest class of its buckets. Buckets that then still hold several groups are cut in blocks;
cells of two blocks compare the signatures of classes in different groups, whole columns at a time, and emit only pairs
that agree often enough to be confirmed, each in the first band where it agrees.

Defined results: a null text is empty; documents without words are linked with nothing; rows without an id are linked
with nothing and have no group; repeated rows fall in one group; an empty table gives no rows; columns other than the
two named ones are not read. Bands are chosen so that a pair exactly at the threshold is missed with a probability of
about 0.00002; more similar pairs are missed less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalake.llm.components import components
from catalake.llm.native import bit_table, may_occur
from catalake.llm.shared import written
from catalake.llm.wordsets import mix, shingle_sets, slices

WIDTH = 5
VALUES = 432
MISS = 3e-5
#: Signatures agreeing less than the threshold by so many standard deviations are not confirmed.
DEVIATIONS = 4.0
#: Classes of a bucket that one side of a cell holds.
BLOCK = 256
#: Longs in the table of wanted texts.
WANTED_CELLS = 1 << 18
_RANDOM = np.random.Generator(np.random.PCG64(7))
_FACTORS = _RANDOM.integers(0, 1 << 63, VALUES // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 63, VALUES // 2, dtype=np.uint64) * np.uint64(2)
_STEP = 4096


def band_rows(percent: int) -> int:
    """The longest band length whose bands still miss a pair at the threshold with less than MISS."""
    share = percent / 100
    fits = [r for r in range(1, VALUES + 1) if (1 - share**r) ** (VALUES // r) <= MISS]
    return max(fits, default=1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under every permutation: all minima, then all maxima."""
    low = high = None
    for at in range(0, len(shingles), _STEP):
        seen = (shingles[None, at : at + _STEP] ^ _MASKS[:, None]) * _FACTORS[:, None]
        a, b = seen.min(axis=1), seen.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return mix(np.concatenate([low, high]))


def _sketches(width: int, rows: int):
    bands = VALUES // rows
    places = mix(np.arange(1, rows + 1, dtype=np.uint64))
    numbers = mix(np.arange(1001, 1001 + bands, dtype=np.uint64))

    def parts(batches):
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1)):
                yield batch.column(0).slice(done, len(texts)), texts
                done += len(texts)

    def sketch(batches):
        for row, texts in parts(batches):
            sizes, one, two, keys, short = [], [], [], [], []
            for s in shingle_sets(texts, width):
                sizes.append(len(s))
                if not len(s):
                    one.append(None), two.append(None), keys.append([]), short.append(b"")
                    continue
                values = signature(s)
                spread = mix(s)
                one.append(int(spread.sum().view(np.int64)))
                two.append(int(np.bitwise_xor.reduce(s * _FACTORS[0]).view(np.int64)))
                banded = (values[: bands * rows].reshape(bands, rows) * places).sum(axis=1)
                keys.append(mix(banded ^ numbers).view(np.int64))
                short.append(values.astype(np.uint8).tobytes())
            yield pa.record_batch(
                [row, pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                names=["id", "n", "one", "two", "keys", "signature"],
            )

    return sketch


def _least_agreement(percent: int) -> float:
    share = percent / 100
    return (share - DEVIATIONS * (share * (1 - share) / VALUES) ** 0.5) * VALUES


def _agreeing(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures agree often enough to be confirmed."""
    least = _least_agreement(percent)
    short = sketches.select("id", "signature")
    both = (
        pairs.join(short.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a")
        .join(short.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b")
    )

    def compare(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, VALUES) for i in (2, 3))
            keep = (x == y).sum(axis=1) >= least
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    pairs = written(pairs, "candidates")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # a table of fixed size keeps most texts out of the exact join
    table = bit_table(wanted.select(F.xxhash64("id").alias("key")), "key", WANTED_CELLS).scalar()
    likely = texts.filter(may_occur(table, F.xxhash64("id"), WANTED_CELLS))
    found = written(likely.join(wanted, "id", "left_semi"), "texts")
    both = (
        pairs.join(found.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
        .join(found.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    )

    def compare(batches):
        for batch in batches:
            keep = []
            for s, t in zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width), strict=True):
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(s) + len(t) - shared))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")


def _alike(n: str, m: str, percent: int):
    """Sizes that similar sets can have."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _within_cells(percent: int, rows: int):
    """Pairs of each cell that agree often enough, are in different groups and meet in no earlier band.

    Bands are compared by their 64-bit keys, those of the buckets: a band whose short values agree need not be shared.
    Rows come sorted by cell: key, x, y, band, id, n, label, block, signature, keys.
    """
    least, bands = _least_agreement(percent), VALUES // rows

    def pairs_of(cell: pa.Table):
        x, y, band = (cell.column(c)[0].as_py() for c in ("x", "y", "band"))
        ids, n, label, block = (cell.column(c).to_numpy() for c in ("id", "n", "label", "block"))
        s = np.frombuffer(b"".join(cell.column("signature").to_pylist()), np.uint8).reshape(-1, VALUES)
        # the keys of this band and of those before it, one row for each class
        keys = cell.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, bands)[:, : band + 1]
        for i in range(len(ids) - 1):
            apart = label[i + 1 :] != label[i]
            apart &= np.minimum(n[i + 1 :], n[i]) * 100 >= np.maximum(n[i + 1 :], n[i]) * percent
            if x != y:
                apart &= block[i + 1 :] != block[i]
            other = np.flatnonzero(apart) + i + 1
            if not len(other):
                continue
            other = other[(s[other] == s[i]).sum(axis=1) >= least]
            for j in other[(keys[other] == keys[i]).argmax(axis=1) == band].tolist():
                yield min(ids[i], ids[j]), max(ids[i], ids[j])

    def run(batches):
        held = None
        for batch in batches:
            rows_here = pa.Table.from_batches([batch])
            held = rows_here if held is None else pa.concat_tables([held, rows_here])
            if not held.num_rows:
                continue
            cuts = _starts(held)
            yield from _pairs(held, cuts, pairs_of)
            held = held.slice(cuts[-1]).combine_chunks()
        if held is not None and held.num_rows:
            yield from _pairs(held, [*_starts(held), held.num_rows], pairs_of)

    return run


def _starts(table: pa.Table) -> list[int]:
    """Rows at which a cell begins."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for name in ("key", "x", "y"):
        values = table.column(name).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change).tolist()


def _pairs(table: pa.Table, cuts: list[int], pairs_of):
    found = [p for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1 for p in pairs_of(table.slice(a, b - a))]
    if found:
        a, b = zip(*found, strict=True)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _links(sketches: DataFrame, texts: DataFrame, percent: int, width: int, rows: int) -> DataFrame:
    """(id, label) of the classes that are not the smallest of their group; ``sketches`` has one row for each class."""
    members = sketches.select("id", "n", F.posexplode("keys").alias("band", "key"))
    heads = (
        members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("head"), F.count("*").alias("c")).filter("c > 1")
    )
    live = written(members.join(heads, "key").select("key", "band", "id", "n", "head", "c"), "buckets")
    first = (
        live.filter(F.col("id") != F.col("head.id")).filter(_alike("n", "head.n", percent))
        .select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct()
    )
    labels = components(_confirmed(_agreeing(first, sketches, percent), texts, percent, width))
    # a bucket of two has been looked at; others are open while they hold several groups
    placed = live.filter("c > 2").select("key", "band", "id", "n", "c").join(labels, "id", "left")
    placed = placed.withColumn("label", F.coalesce("label", "id"))
    open_keys = placed.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q")).filter("p < q").select("key")
    blocks = F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")
    cells = (
        placed.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .join(sketches.select("id", "signature", "keys"), "id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "band", "id", "n",
                "label", "block", "signature", "keys")
        .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    )
    pairs = cells.mapInArrow(_within_cells(percent, rows), "a long, b long")
    links = _confirmed(pairs, texts, percent, width)
    return components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(links))


def near_duplicates(
    docs: DataFrame, percent: int = 80, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, group) per document; ``group`` is the smallest id that links of similarity percent/100 reach."""
    rows = band_rows(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = written(
        texts.mapInArrow(
            _sketches(width, rows), "id long, n long, one long, two long, keys array<long>, signature binary"
        ),
        "sketches",
    )
    known = sketches.filter("id is not null and n > 0")
    classes = written(known.groupBy("n", "one", "two").agg(F.min("id").alias("first")), "classes")
    leaders = (
        known.join(classes.select(F.col("first").alias("id")), "id", "left_semi").select("id", "n", "keys", "signature")
        .dropDuplicates(["id"])
    )
    leaders = written(leaders, "leaders")
    labels = _links(leaders, texts.dropna(subset=["id"]), percent, width, rows)
    groups = classes.join(labels.withColumnRenamed("id", "first"), "first", "left").select(
        "n", "one", "two", F.coalesce("label", "first").alias("group")
    )
    return (
        sketches.select("id", "n", "one", "two").join(groups, ["n", "one", "two"], "left")
        .select("id", F.col("n").alias("n_shingles"), F.coalesce("group", "id").alias("group"))
    )


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, the one of the smallest id (one of its rows, if they repeat)."""
    later = near_duplicates(docs, percent).filter(F.col("id") != F.col("group")).select(F.col("id").alias("doc_id"))
    return docs.join(later, "doc_id", "left_anti")
