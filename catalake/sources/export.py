"""CSV exports that become visible only when they are right.

The rows are recorded first, checked as they stand, and written from the record, so that what is checked is what is
exported. Spark's committer moves finished files into place and marks the folder last; a failed task or check leaves no
``_SUCCESS`` behind, and an existing export is never written over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalake.operators.report import export_safe
from catalake.sources.recorded import recorded

#: Spreadsheets take a file for UTF-8 if it begins with this.
MARK = "﻿"


class ExportRefused(ValueError):
    """The rows are not what the export promises; nothing was written."""


def refusals(rows: DataFrame, total: int | None, unique: list[str]) -> list[str]:
    """Why the rows must not be exported: another number of rows than announced, keys that are missing or occur twice."""
    found = []
    n = rows.count()
    if total is not None and n != total:
        found.append(f"{n} rows instead of {total}")
    if unique:
        shown = F.concat_ws("|", *[F.col(c).cast("string") for c in unique])
        keyed = rows.groupBy(*unique).agg(F.count(F.lit(1)).alias("n"), F.min(shown).alias("shown"))
        missing = F.lit(False)
        for name in unique:
            missing |= F.col(name).isNull()
        bad = keyed.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.min(F.when(F.col("n") > 1, F.col("shown"))).alias("first"),
                        F.sum(F.when(missing, F.col("n"))).alias("missing")).first()
        if bad["repeated"]:
            found.append(f"{bad['repeated']} keys occur twice, first {bad['first']}")
        if bad["missing"]:
            found.append(f"{bad['missing']} rows without a key")
    return found


def export_csv(rows: DataFrame, path: str, columns: list[str], order: list[Column | str] = (), total: int | None = None, unique: list[str] = ()) -> int:
    """Write ``columns`` of the rows as CSV below ``path``; the number of rows written.

    Cells that a spreadsheet would run as formulas are made safe. Every file begins with a byte order mark and one header;
    files follow each other in ``order``, which may name columns that are not shown. ``total`` is the number of rows that
    the caller announced elsewhere, ``unique`` the columns that name a row; if either doesn't hold, ``ExportRefused``.
    """
    kept = recorded(rows, "export")
    found = refusals(kept, total, list(unique))
    if found:
        raise ExportRefused("; ".join(found))
    ordered = kept.orderBy(*order) if order else kept
    safe = export_safe(ordered.select(*columns))
    named = safe.toDF(MARK + columns[0], *columns[1:])
    options = {"header": True, "encoding": "UTF-8", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}
    named.write.mode("errorifexists").options(**options).csv(path)
    return kept.count()
