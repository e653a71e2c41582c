import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from catalake.llm.components import components
from catalake.llm.near_dedup import (
    VALUES, _within_cells, band_rows, near_duplicates, signature, without_near_duplicates,
)
from catalake.llm.wordsets import shingle_sets
from tests.llm.corpora import SCHEMA, family_corpus, rows


def sets_of(texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for key, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        yield key, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups_of(links, keys):
    group = {k: k for k in keys}
    for _ in keys:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return group


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_equal_brute_force(spark, percent):
    texts = family_corpus()
    sets = dict(sets_of(texts))
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = groups_of(links, sorted(sets))
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    found = {r["id"]: (r["n_shingles"], r["group"]) for r in near_duplicates(docs, percent).collect()}
    assert found == {k: (len(sets[k]), want[k]) for k in sets}
    left = {r["doc_id"] for r in without_near_duplicates(docs, percent).collect()}
    assert left == {k for k in want if want[k] == k}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (5, text), (6, None)], "doc_id long, text string")
    found = sorted((r["id"] or -1, r["group"]) for r in near_duplicates(docs).collect())
    assert found == [(-1, 3), (3, 3), (3, 3), (5, 3), (6, 6)] or found == [(-1, None), (3, 3), (3, 3), (5, 3), (6, 6)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0 and without_near_duplicates(none).columns == ["doc_id", "text"]


def test_signature_agreement_estimates_similarity():
    draw = np.random.Generator(np.random.PCG64(3))
    a = draw.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1800], draw.integers(0, 1 << 63, 200, dtype=np.uint64)])
    agree = (signature(a) == signature(b)).mean()
    assert abs(agree - 1800 / 2200) < 0.15
    assert (1 - 0.85 ** band_rows(85)) ** (VALUES // band_rows(85)) < 3e-5


def test_shingles_of_odd_texts():
    column = pa.array([None, "", "A b", "a B ", "x\ty\nz\x0bq\x0cr s", "x y z q r s", "ä " * 9])
    found = [tuple(s.tolist()) for s in shingle_sets(column, 5)]
    assert found[0] == found[1] == () and found[2] == found[3] and len(found[2]) == 1
    assert found[4] == found[5] and len(found[4]) == 2 and len(found[6]) == 1


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_first_shared_band_is_found_on_whole_keys():
    """Band 0 agrees in the short values only, so the pair meets in the bucket of band 1."""
    length = band_rows(80)
    bands = VALUES // length
    keys = [[10 * k, *range(1, bands)] for k in (1, 2)]
    cell = pa.table({
        "key": [1, 1], "x": [0, 0], "y": [0, 0], "band": [1, 1], "id": [5, 3], "n": [9, 9], "label": [5, 3],
        "block": [0, 0], "signature": pa.array([bytes(VALUES)] * 2, pa.binary()),
        "keys": pa.array(keys, pa.list_(pa.int64())),
    })
    found = [p for b in _within_cells(80, length)(cell.to_batches()) for p in b.to_pylist()]
    assert found == [{"a": 3, "b": 5}]
    later = cell.set_column(3, "band", pa.array([2, 2]))
    assert not list(_within_cells(80, length)(later.to_batches()))
