"""Benchmark decontamination by SimHash windows.

For an item of L words, the windows of L words of every document are compared with it. Each has a 64-bit SimHash of its
shingles of five words. Fingerprints are cut in RADIUS + 1 blocks: two fingerprints within RADIUS agree in some block
whole, so the join over blocks finds all of them. Candidates are verified by the exact similarity of the two bags of
shingles (weights are multiplicities): the sum of smaller weights over the sum of larger ones, ``SIMILARITY`` or more.

Only windows that begin with a shingle of some item are fingerprinted (or, near the end of a document, the last window
that still holds it). Nothing is lost by that: a window without a shared shingle has similarity zero, and all windows of
L words have equally many shingles, so sliding one to its first shared shingle, or to the end, never lowers the
similarity. Shared shingles are found in one scan by a bit table of fixed size, then by a join that is exact.

Everything is SQL functions. A pair at the threshold exactly has a fingerprint distance of 10 on average with a standard
deviation of 3; RADIUS is three deviations above, so about one such borderline pair in 1,000 is missed, and practically
no closer ones.

An item of fewer than five words is one shingle of its own length; so are the windows that it is compared with, and all runs
of so many words are looked up.

Defined results: null and empty texts and items match nothing; a text of fewer than five words is one shingle; a text
shorter than an item is one window; rows are told apart by id and text, so of two texts of one id each is compared, and
repeated rows give each match once; with no items nothing matches; columns besides ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalake.llm.native import WIDTH, bit_table, may_occur, shingle_at, shingles_of, words_of
from catalake.llm.shared import written

SIMILARITY = 0.8
RADIUS = 19
CELLS = 1 << 16
_ROW = ["doc_id", "mark"]


def _spread(value: Column, place: int) -> Column:
    """Four bits of a hash as four counters of 16 bits."""
    x = F.shiftright(value, 4 * place).bitwiseAND(F.lit(15))
    apart = x.bitwiseOR(F.shiftleft(x, 15)).bitwiseOR(F.shiftleft(x, 30)).bitwiseOR(F.shiftleft(x, 45))
    return apart.bitwiseAND(F.lit(0x0001000100010001))


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the SimHash of each row's shingles: a bit is one if more than half of the shingles have it."""
    exploded = rows.select(*keys, F.explode("shingles").alias("s"))
    sums = exploded.groupBy(*keys).agg(
        F.count("*").alias("of"), *[F.sum(_spread(F.col("s"), i)).alias(f"c{i}") for i in range(16)]
    )
    bits = None
    for i in range(16):
        for j in range(4):
            many = F.shiftright(f"c{i}", 16 * j).bitwiseAND(F.lit(0xFFFF)) * 2 > F.col("of")
            bit = F.when(many, F.expr(f"shiftleft(1L, {4 * i + j})")).otherwise(F.lit(0).cast("long"))
            bits = bit if bits is None else bits.bitwiseOR(bit)
    return sums.select(*keys, bits.alias("print"))


def blocks(print_: Column) -> Column:
    """The fingerprint's RADIUS + 1 blocks, each with its number in the upper bits."""
    cuts = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(*[
        F.call_function("shiftrightunsigned", print_, F.lit(a)).bitwiseAND(F.lit((1 << (b - a)) - 1)) + (i << 8)
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
    ])


def _numbered(shingles: Column) -> Column:
    """A bag as a set: repeated shingles get the number of the repetition."""
    again = F.transform(
        shingles, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(shingles, F.lit(1), i), lambda y: y == x)))
    )
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.transform(shingles, lambda x: F.xxhash64(x, F.lit(0)))).otherwise(again)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, similarity): the best window of each document for each item it contains.

    ``start`` is the 0-based word at which the window begins; of equally similar windows the first.
    """
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back")))
    return _verified(docs, benchmark).groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.similarity").alias("similarity")
    )


def _mark() -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64("text")


def _short(words: DataFrame, keys: DataFrame) -> DataFrame:
    """Windows of fewer than five words that are an item's."""
    keys = keys.filter(F.col("length") < WIDTH)
    table = bit_table(keys, "key", CELLS).scalar()
    places = words.select(*_ROW, "words", F.posexplode("words").alias("start", "word"))
    runs = places.select(*_ROW, "words", "start", F.explode(F.sequence(F.lit(1), F.lit(WIDTH - 1))).alias("length"))
    part = F.slice("words", F.col("start") + 1, F.col("length"))
    # the same hash as that of a whole item of so many words, where nothing follows
    word = lambda i: F.when(F.col("length") > i, F.get("words", F.col("start") + i))
    runs = runs.filter(F.col("start") + F.col("length") <= F.size("words")).withColumn("key", F.xxhash64(*[word(i) for i in range(WIDTH)]))
    return runs.filter(may_occur(table, F.col("key"), CELLS)).join(keys, ["key", "length"], "left_semi").select(
        *_ROW, "start", "length", part.alias("words")
    )


def _verified(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, mark, item_id, start, similarity) of all windows that are similar enough."""
    items = (
        benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
        .select("item_id", F.size("words").alias("length"), shingles_of(F.col("words")).alias("shingles"))
        .dropna(subset=["item_id"]).distinct()
    )
    items = written(items.withColumn("bag", _numbered(F.col("shingles"))), "items")
    keys = items.select(F.explode("shingles").alias("key"), "length").distinct()
    longest = items.agg(F.coalesce(F.max("length"), F.lit(0)).alias("n")).scalar()
    table = bit_table(keys, "key", CELLS).scalar()

    words = docs.select("doc_id", _mark().alias("mark"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    # one row for each shingle; those of short texts have only nulls after the last word
    places = words.select(*_ROW, "words", F.posexplode("words").alias("place", "word"))
    placed = places.filter(F.col("place") <= F.greatest(F.size("words") - WIDTH, F.lit(0))).withColumn(
        "key", shingle_at(F.col("words"), F.col("place"))
    )
    hits = placed.filter(may_occur(table, F.col("key"), CELLS)).select(
        *_ROW, "place", "key", F.size("words").alias("n"),
        F.least("place", F.greatest(F.size("words") - longest, F.lit(0))).alias("from"), "words",
    ).select(*_ROW, "place", "key", "n", "from", F.slice("words", F.col("from") + 1, F.greatest(longest, F.lit(1))).alias("part"))
    start = F.least("place", F.greatest(F.col("n") - F.col("length"), F.lit(0)))
    windows = (
        hits.join(keys, "key").withColumn("start", start)
        .select(*_ROW, "start", "length", F.slice("part", F.col("start") - F.col("from") + 1, F.col("length")).alias("words"))
        .union(_short(words, keys)).groupBy(*_ROW, "start", "length").agg(F.first("words").alias("words"))
        .select(*_ROW, "start", "length", shingles_of(F.col("words")).alias("shingles"))
    )
    windows = written(windows, "windows")

    place = [*_ROW, "start", "length"]
    prints = fingerprints(windows, place).select(*place, "print", F.explode(blocks(F.col("print"))).alias("block"))
    item_prints = fingerprints(items, ["item_id", "length"]).select(
        "item_id", "length", F.col("print").alias("item_print"), F.explode(blocks(F.col("print"))).alias("block")
    )
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    pairs = prints.join(item_prints, ["length", "block"]).filter(near).select(*place, "item_id").distinct()
    shared = F.size(F.array_intersect("w_bag", "bag"))
    similarity = shared / (F.size("w_bag") + F.size("bag") - shared)
    return (
        pairs.join(windows.withColumn("w_bag", _numbered(F.col("shingles"))).drop("shingles"), place)
        .join(items.select("item_id", "bag"), "item_id")
        .select(*_ROW, "item_id", "start", similarity.alias("similarity")).filter(F.col("similarity") >= SIMILARITY)
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item was found."""
    found = _verified(docs, benchmark).select("doc_id", F.col("mark").alias("_found_mark")).distinct()
    same = (docs["doc_id"] == found["doc_id"]) & (F.xxhash64(docs["text"]) == found["_found_mark"])
    return docs.join(found, same, "left_anti")
