"""The registered queries at the smallest scale, and the pipeline's stages against each other."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from catalake.llm.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark labels conversations".split()


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=str)
    assert sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=str) == want


def test_stages_follow_on_each_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, FOLDER).collect(), docs.schema)
        assert after.columns == docs.columns
        old, new = ({r["doc_id"]: r["text"] for r in f.collect()} for f in (before, after))
        assert set(new) <= set(old) and len(new) == after.count()
        if name == "line_dedup":
            assert set(new) == set(old)
        else:
            assert all(new[i] == old[i] for i in new)
        before = after
    last = corpus_pipeline.run(spark, FOLDER)
    assert {r["doc_id"]: (r["decoded"], r["round_trip"]) for r in last.collect()} == {i: (t, True) for i, t in new.items()}
