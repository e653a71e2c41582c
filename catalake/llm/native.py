"""Words and word shingles as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
BLANK = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Lower-case words between white space; no words for a null or blank text."""
    clean = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANK))
    return F.when(clean == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(clean, "[ \t\n\x0b\x0c\r]+"))


def shingle_at(words: Column, place: Column, width: int = WIDTH) -> Column:
    """Hash of the ``width`` words from a 0-based place; fewer where the words end."""
    return F.xxhash64(*[F.get(words, place + i) for i in range(width)])


def shingles_of(words: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of ``width`` words, in order; the whole sequence as one where there are fewer words."""
    last = F.greatest(F.size(words) - width, F.lit(0))
    return F.when(F.size(words) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: shingle_at(words, i, width))
    )


def bit_table(keys: DataFrame, key: str, size: int) -> DataFrame:
    """One row, one array of ``size`` longs whose bits say which keys may occur; its size doesn't follow the input's."""
    marked = keys.select((F.shiftright(key, 6).bitwiseAND(F.lit(size - 1))).cast("int").alias("at"),
                         F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit"))
    empty = keys.sparkSession.range(size).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("bit"))
    cells = marked.union(empty).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    return cells.agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("c")).select(F.col("c.bits").alias("table"))


def may_occur(table: Column, key: Column, size: int) -> Column:
    cell = F.get(table, F.shiftright(key, 6).bitwiseAND(F.lit(size - 1)).cast("int"))
    return F.call_function("shiftrightunsigned", cell, key.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
