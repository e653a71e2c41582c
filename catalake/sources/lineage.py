"""Identity, lineage and file-name columns of incoming data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalake.functions.text import leaf_name, shorten_keeping_suffix, strip

# Where a batch may come from.
SOURCE_TYPES = ("unknown", "upload", "s3", "http_feed", "cli")
FEED_REFERENCE = "configured_http_feed"  # stands in for a feed address, which may hold secrets
MAX_REFERENCE = 255


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def stored_file_name(path: Column, default: str = "uploaded.csv") -> Column:
    name = leaf_name(path)
    return F.when(name == "", F.lit(default)).otherwise(shorten_keeping_suffix(name))


def object_reference(key: Column, prefix: str | None = None) -> Column:
    """Place of an object inside the allowed area: no bucket, no configured prefix."""
    flat = strip(F.translate(key, "\\", "/"))
    if prefix:
        flat = F.when(F.startswith(flat, F.lit(prefix)), F.substr(flat, F.lit(len(prefix) + 1))).otherwise(flat)
    return F.ltrim(flat, F.lit("/"))


def with_lineage(arrivals: DataFrame, prefix: str | None = None) -> DataFrame:
    """Adds ``source_type_ok`` and ``source_ref`` (NULL when blank) to rows with ``source_type`` and ``path``."""
    by_type = (
        F.when(F.col("source_type") == "s3", object_reference(F.col("path"), prefix))
        .when(F.col("source_type") == "http_feed", F.lit(FEED_REFERENCE))
        .otherwise(leaf_name(F.col("path")))
    )
    return arrivals.withColumns(
        {
            "source_type_ok": F.col("source_type").isin(*SOURCE_TYPES),
            "source_ref": F.left(F.nullif(strip(by_type), F.lit("")), F.lit(MAX_REFERENCE)),
        }
    )
