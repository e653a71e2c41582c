"""Text table -> typed product catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalake.functions.text import strip, whole_number
from catalake.functions.vocabulary import OPTIONAL_COLUMNS, REQUIRED_COLUMNS

NUMBER_COLUMNS = ("stock", "price", "sale_price")


class MissingColumns(ValueError):
    """The table lacks required catalog columns."""


def load_catalog(table: DataFrame, row_index: str = "row_index") -> DataFrame:
    """Typed products of a text table that carries a 0-based row position.

    Blank texts are '' (never NULL); numbers that cannot be read are NULL. Extra columns are dropped.
    """
    missing = [name for name in REQUIRED_COLUMNS if name not in table.columns]
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    text = {
        name: strip(F.col(name).cast("string")) if name in table.columns else F.lit("")
        for name in (*REQUIRED_COLUMNS, *OPTIONAL_COLUMNS)
    }
    columns = [F.col(row_index).cast("bigint").alias("row_index")]
    for name in REQUIRED_COLUMNS:
        value = whole_number(text[name]) if name in NUMBER_COLUMNS else text[name]
        columns.append(value.alias(name))
    columns += [
        whole_number(text["sale_price"]).alias("sale_price"),
        (text["sale_price"] != "").alias("sale_price_provided"),
        text["description"].alias("description"),
        text["seller"].alias("seller"),
    ]
    return table.select(*columns)
