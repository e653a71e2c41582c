import tempfile
from collections import Counter

from pyspark.sql import functions as F

from catalake.llm.token_counts import Rollup, _encoding, counted
from tests.llm.corpora import SCHEMA, rows

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def plain(changes):
    documents, tokens = Counter(), Counter()
    for source, text, sign in changes:
        documents[source] += sign
        tokens[source] += sign * len(_encoding(PATH).encode_ordinary(text or ""))
    return {s: (documents[s], tokens[s]) for s in documents if documents[s] or tokens[s]}


def totals(rollup):
    return {r["source"]: (r["documents"], r["tokens"]) for r in rollup.totals().collect()}


def test_signed_batches_add_up_and_repeat_safely(spark):
    came = [("a", "Hello there", 1), ("a", "", 1), ("b", "one two three", 1), (None, None, 1), ("c", "gone", 1), ("a", "Hello there", 1)]
    later = [("b", "one two three", -1), ("b", "one two", 1), ("c", "gone", -1)]
    frame = lambda c: counted(
        spark.createDataFrame([(s, "en", t, g) for s, t, g in c], "source string, lang string, text string, sign int"), {"v1": PATH})
    rollup = Rollup(spark, tempfile.mkdtemp() + "/rollup")
    rollup.commit("one", frame(came))
    assert totals(rollup) == plain(came)
    for _ in range(2):
        rollup.commit("two", frame(later))
        rollup.commit("one", frame(came))
        assert totals(rollup) == plain(came + later)
    rollup.commit("two", frame(later[:1]))
    assert totals(rollup) == plain(came + later[:1])


def test_other_columns_long_texts_and_empty_tables(spark):
    docs = spark.createDataFrame(rows({1: "word " * 30_000, 2: None}), SCHEMA).withColumn("n_tokens", F.lit("clash"))
    found = {r["doc_id"]: r for r in counted(docs, {"v1": PATH, "v2": PATH}).collect()}
    assert found[1]["n_tokens"] == {"v1": 30_001, "v2": 30_001} or found[1]["n_tokens"]["v1"] >= 30_000
    assert found[2]["n_tokens"] == {"v1": 0, "v2": 0} and found[1]["words"] == "y"
    rollup = Rollup(spark, tempfile.mkdtemp() + "/rollup")
    rollup.commit("none", counted(docs.limit(0), {"v1": PATH}).withColumn("sign", F.lit(1)))
    assert rollup.totals().count() == 0
