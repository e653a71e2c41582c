"""Pages against slices of a sorted list."""

import random
import re

import pytest
from pyspark.sql import functions as F

from catalake.operators.pages import read_page, total, write_pages


def test_pages_equal_slices(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.randrange(9), i) for i in range(1_000)]
    path = str(tmp_path / "list")
    write_pages(spark.createDataFrame(rows, "score long, id long").repartition(6), [F.desc("score"), F.col("id")], path, rows_per_part=100)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    for offset, limit in ((0, 20), (95, 30), (500, 1), (990, 50), (1_000, 10)):
        assert [(r["score"], r["id"]) for r in read_page(spark, path, offset, limit).collect()] == want[offset : offset + limit]
    assert total(spark, path) == 1_000
    plan = read_page(spark, path, 500, 5)._jdf.queryExecution().executedPlan().toString()
    chosen = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)[1]
    assert "part" in chosen and len(re.findall(r"\b\d+\b", re.sub(r"#\d+", "", chosen))) <= 2
    with pytest.raises(ValueError):
        read_page(spark, path, -1, 5)
