"""Supplier CSV files: scan, admission and row extraction.

Files arrive as rows of the ``binaryFile`` source (path, length, content). One file is one record of that source, so
it is decoded and parsed as a whole inside a task; files are the unit of parallel work. Everything that can be said
without parsing is said by columns, and Python sees only the bytes of files that passed. One pass gives both the
verdict on a file and its records. No file is refused for its size unless the caller sets a limit.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalake.functions.text import leaf_name

# Encodings in the order they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949")
FEED_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
ADMITTED = "ok"
# Verdicts that depend on the caller's limits and not on the content alone.
LIMIT_VERDICTS = ("too_large", "too_many_rows")


@dataclass(frozen=True)
class Limits:
    """Admission limits; None means none."""

    max_bytes: int | None = None
    max_rows: int | None = None


def scan_feeds(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a local or object-store prefix."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.load(path)


class _Refused(Exception):
    def __init__(self, status: str, detail: str = "") -> None:
        super().__init__(status)
        self.status, self.detail = status, detail


def _decoded(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise _Refused("undecodable")


def _blank(cells: list[str]) -> bool:
    return not any(cell.strip() for cell in cells)


def _header(first: list[str], required: Iterable[str]) -> list[str]:
    names = [name.strip() for name in first]
    if not names or "" in names:
        raise _Refused("blank_header")
    first_spelling: dict[str, str] = {}
    repeated: dict[str, None] = {}
    for name in names:
        known = first_spelling.setdefault(name.casefold(), name)
        if known is not name:
            repeated[known] = None
    if repeated:
        raise _Refused("duplicate_header", ", ".join(repeated))
    missing = [name for name in required if name not in names]
    if missing:
        raise _Refused("missing_columns", ", ".join(missing))
    return names


def _records(content: bytes, required: Iterable[str], max_rows: int | None) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """Header and numbered records (the header is record 1; blank records keep their number but are dropped)."""
    text = _decoded(content)
    if not text.lstrip("﻿").strip():
        raise _Refused("blank_text")
    reader = csv.reader(io.StringIO(text), strict=True)
    try:
        names = _header(next(reader), required)
        rows = []
        for number, cells in enumerate(reader, start=2):
            if _blank(cells):
                continue
            if len(cells) != len(names):
                raise _Refused("ragged_row", str(number))
            rows.append((number, cells))
    except csv.Error:
        raise _Refused("malformed_csv") from None
    if not rows:
        raise _Refused("no_rows")
    if max_rows is not None and len(rows) > max_rows:
        raise _Refused("too_many_rows", str(len(rows)))
    return names, rows


def _bytes_verdict(limits: Limits):
    """First failing check that needs no parsing, else NULL."""
    checks = F.when(~F.lower(leaf_name(F.col("path"))).endswith(".csv"), "bad_extension").when(
        F.col("length") == 0, "empty_file"
    )
    if limits.max_bytes is not None:
        checks = checks.when(F.col("length") > limits.max_bytes, "too_large")
    return checks.when(F.expr("position(X'00' IN content)") > 0, "nul_byte")


PARSED = "path string, status string, detail string, source_row_number bigint, values map<string,string>"


def parse_feeds(files: DataFrame, required: tuple[str, ...], limits: Limits = Limits(), with_rows: bool = True) -> DataFrame:
    """Verdicts and records of files in one pass.

    A verdict row has the status ('ok' or the first failing check), its detail and no row number; record rows follow
    for admitted files, with ``values`` from source column to text.
    """
    judged = files.select("path", "content", _bytes_verdict(limits).alias("status"))
    no_record = [F.lit(None).cast("bigint").alias("source_row_number"), F.lit(None).cast("map<string,string>").alias("values")]
    quick = judged.where("status IS NOT NULL").select("path", "status", F.lit("").alias("detail"), *no_record)
    max_rows, chunk = limits.max_rows, 5_000  # rows handed to Spark at a time, so a large file is never held twice

    def verdict(path: str, status: str, detail: str) -> pd.DataFrame:
        row = {"path": path, "status": status, "detail": detail, "source_row_number": None, "values": None}
        return pd.DataFrame([row]).astype({"source_row_number": "Int64"})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    names, rows = _records(bytes(content), required, max_rows)
                except _Refused as refusal:
                    yield verdict(path, refusal.status, refusal.detail)
                    continue
                yield verdict(path, ADMITTED, "")
                for start in range(0, len(rows) if with_rows else 0, chunk):
                    part = rows[start : start + chunk]
                    yield pd.DataFrame(
                        {
                            "path": path, "status": ADMITTED, "detail": "",
                            "source_row_number": [number for number, _ in part],
                            "values": [dict(zip(names, cells, strict=True)) for _, cells in part],
                        }
                    )

    return quick.unionByName(judged.where("status IS NULL").select("path", "content").mapInPandas(parse, PARSED))


def verdicts_of(parsed: DataFrame) -> DataFrame:
    """(path, status, detail) of parsed files."""
    return parsed.where("source_row_number IS NULL").select("path", "status", "detail")


def records_of(parsed: DataFrame) -> DataFrame:
    """(path, source_row_number, values) of admitted files."""
    return parsed.where("source_row_number IS NOT NULL").select("path", "source_row_number", "values")


def admit_feeds(files: DataFrame, required: tuple[str, ...], limits: Limits = Limits()) -> DataFrame:
    return verdicts_of(parse_feeds(files, required, limits, with_rows=False))


def feed_rows(files: DataFrame, required: tuple[str, ...], limits: Limits = Limits()) -> DataFrame:
    return records_of(parse_feeds(files, required, limits))


def widened(rows: DataFrame, columns: tuple[str, ...], keep: list[str]) -> DataFrame:
    """Source columns of the ``values`` map as columns of their own."""
    return rows.select(*keep, *[F.try_element_at("values", F.lit(name)).alias(name) for name in columns])
