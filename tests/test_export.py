"""Exports: what is written, and that nothing is written when a check or a task fails."""

import csv
import os

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from catalake.sources.export import MARK, ExportRefused, export_csv

SCHEMA = "id long, place long, name string, note string"
ROWS = [(2, 1, "=cmd", 'say "hi"'), (1, 0, "plain", None), (3, 2, "가방, 신발", "two\nlines"), (4, 3, "", "'@x")]


def read(path):
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return [list(csv.reader(open(os.path.join(path, f), encoding="utf-8", newline=""))) for f in files]


def test_files_with_mark_header_order_and_safe_cells(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    path = str(tmp_path / "out")
    assert export_csv(frame, path, ["id", "name", "note"], ["place"], total=4, unique=["id"]) == 4
    files = read(path)
    assert all(rows[0] == [MARK + "id", "name", "note"] for rows in files) and os.path.exists(f"{path}/_SUCCESS")
    assert [r for rows in files for r in rows[1:]] == [["1", "plain", ""], ["2", "'=cmd", 'say "hi"'], ["3", "가방, 신발", "two\nlines"], ["4", "", "'@x"]]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        export_csv(frame, path, ["id"])


@pytest.mark.parametrize("total, extra, why", [(5, [], "4 rows instead of 5"), (5, [(1, 9, "x", "y")], "1 keys occur twice, first 1"),
                                               (None, [(None, 9, "x", "y")], "1 rows without a key")])
def test_refused_exports_leave_nothing(spark, tmp_path, total, extra, why):
    path = str(tmp_path / "out")
    with pytest.raises(ExportRefused, match=why):
        export_csv(spark.createDataFrame(ROWS + extra, SCHEMA), path, ["id", "name"], total=total, unique=["id"])
    assert not os.path.exists(path)


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    broken = F.udf(lambda i: 1 // (i - 3), "long")
    path = str(tmp_path / "out")
    with pytest.raises(PythonException):
        export_csv(spark.createDataFrame(ROWS, SCHEMA).withColumn("x", broken("id")), path, ["id", "x"])
    assert not os.path.exists(path)
