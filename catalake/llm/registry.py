"""Registered queries of the corpus operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from catalake.llm import ann, chat, decontaminate, line_dedup, oracles, pieces, pii, quality, token_counts, toxicity
from catalake.llm.near_dedup import near_duplicates
from catalake.llm.phrases import collocations
from catalake.llm.repeats import without_repeats
from catalake.llm.shared import shared_folder, table, written
from catalake.llm.variants import variants

TOKENIZERS = corpus_pipeline.TOKENIZERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(build):
    QUERIES[build.__name__] = build
    if hasattr(oracles, build.__name__.upper()):
        ORACLES[build.__name__] = getattr(oracles, build.__name__.upper())
    return build


@_query
def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether the pieces spell the text."""
    found = pieces.encode_and_decode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model", ["doc_id"])
    return found.select("doc_id", "n_pieces", "piece_ids", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier ones."""
    docs = table(spark, sf_dir, "documents")
    return line_dedup.without_repeated_lines(docs.select("doc_id", "text"))


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after all documents came, some were withdrawn or moved to another source, and a batch came twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    versions = {name: f"{TOKENIZERS}/{name}.tiktoken" for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    known = written(token_counts.counted(docs, versions), "counted")
    came = known.withColumn("sign", F.lit(1))
    withdrawn = known.filter("doc_id % 10 = 3").withColumn("sign", F.lit(-1))
    revised = known.filter("doc_id % 10 = 7").withColumn("sign", F.lit(-1))
    moved = revised.withColumns({"source": F.lit("archive"), "sign": F.lit(1)})
    rollup = token_counts.Rollup(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}")
    rollup.commit("came", came)
    rollup.commit("changed", withdrawn.union(revised).union(moved))
    rollup.commit("came", came)
    return rollup.totals()


@_query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = turns.union(planted).withColumn("parts", chat.text_part(F.col("text"))).drop("text")
    return chat.read_back(chat.format_turns(turns))


@_query
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@_query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        F.col("id").alias("doc_id"), *[count(kind) for kind in pii.BASE],
        F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"),
    )


@_query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark, one row for each item found."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document, and whether it is rejected."""
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *toxicity.ADDED, (F.col(toxicity.ADDED[-1]) >= toxicity.THRESHOLD).alias("toxic"))


@_query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents of similarity 0.85 or more."""
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("group").alias("component_id"),
        F.col("id").eqNullSafe(F.col("group")).alias("kept"),
    )


@_query
def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent words that they may be variants of."""
    return variants(table(spark, sf_dir, "documents"))


@_query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest collocations of two and three words of each language."""
    return collocations(table(spark, sf_dir, "documents"))


@_query
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that start twice."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    return corpus_pipeline.run(spark, sf_dir)
