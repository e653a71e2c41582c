"""Token counts by source, language and tokenizer version, kept up to date by signed changes.

A change is a document with a sign: +1 for what comes, -1 for what goes; a revision is both. Counting turns changes into
deltas (documents and tokens with the sign), which are summed per source, language and version before any shuffle. A
batch's deltas are one partition of the delta table, named by the batch, and committing it replaces that partition; a
batch that is committed again therefore leaves the totals as they are. Totals are the sums over all partitions.

Defined results: a null or empty text has no tokens but is a document; null sources and languages are groups of their
own; a null sign changes nothing; repeated rows count each time; groups whose documents and tokens are both back to zero
are left out; no batches give no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP = ("source", "lang", "version")
_DELTAS = "source string, lang string, version string, documents long, tokens long, batch string"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(rows: DataFrame, versions: dict[str, str], text_col: str = "text") -> DataFrame:
    """``rows`` without the text, with a map ``n_tokens`` from version to the count; ``versions`` names rank files."""
    kept = [c for c in rows.columns if c not in (text_col, "n_tokens")]

    def run(batches):
        encodings = {name: _encoding(path) for name, path in versions.items()}
        for batch in batches:
            column = batch.schema.get_field_index(text_col)
            counts = []
            for text in batch.column(column):
                text = text.as_py() or ""
                counts.append([(name, len(e.encode_ordinary(text))) for name, e in encodings.items()])
            others = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != text_col]
            maps = pa.array(counts, pa.map_(pa.string(), pa.int64()))
            yield pa.record_batch([*others, maps], names=[*[c for c in batch.schema.names if c != text_col], "n_tokens"])

    fields = [rows.schema[c] for c in kept]
    out = T.StructType([*fields, T.StructField("n_tokens", T.MapType(T.StringType(), T.LongType()))])
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`")).mapInArrow(run, out)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums per group of changes (source, lang, n_tokens, sign)."""
    signed = changes.dropna(subset=["sign"]).select(
        F.col("source").cast("string"), F.col("lang").cast("string"), "sign", F.explode("n_tokens").alias("version", "n")
    )
    return signed.groupBy(*GROUP).agg(
        F.sum(F.col("sign").cast("long")).alias("documents"), F.sum(F.col("sign") * F.col("n")).cast("long").alias("tokens")
    )


class Rollup:
    """A delta table in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Make ``changes`` the content of a batch, whether it was there before or not."""
        marked = deltas(changes).withColumn("batch", F.lit(batch))
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.folder)

    def totals(self) -> DataFrame:
        rows = self.spark.read.schema(_DELTAS).parquet(self.folder)
        sums = rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.filter("documents <> 0 or tokens <> 0")
