"""Numbers without a global sort."""

import random

import pytest

from catalake.operators.change_ids import dense_ids


@pytest.mark.parametrize("rows_per_part", [3, 40, 10_000])
def test_numbers_follow_the_order(spark, rows_per_part):
    draw = random.Random(rows_per_part)
    rows = [(draw.randrange(4), f"p{i}", "x") for i in range(300)]
    frame = spark.createDataFrame(rows, "run long, product string, other string").repartition(7)
    found = dense_ids(frame, ["run", "product"], "id", 11, rows_per_part).orderBy("id").collect()
    assert [r["id"] for r in found] == list(range(11, 311))
    assert [(r["run"], r["product"]) for r in found] == sorted((a, b) for a, b, _ in rows)
    assert found[0].asDict().keys() == {"run", "product", "other", "id"}


def test_no_rows(spark):
    assert dense_ids(spark.createDataFrame([], "run long"), ["run"], "id").collect() == []
