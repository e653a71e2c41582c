"""Repeated byte strings against brute force, suffix orders against sorting."""

import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from catalake.llm.repeats import WIDTH, without_repeats
from catalake.llm.suffixes import suffix_order
from tests.llm.corpora import SCHEMA, family_corpus


@given(st.integers(1, 5).flatmap(lambda k: st.lists(st.integers(1, k), max_size=60)))
@settings(max_examples=300, deadline=None)
def test_order_equals_sorting(symbols):
    symbols = [*symbols, 0]
    order = suffix_order(symbols)
    assert order == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def brute(texts):
    """Result rows of (id, text) pairs."""
    texts = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(t[p : p + WIDTH] for _, t in texts for p in range(len(t) - WIDTH + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - WIDTH + 1):
            if seen[t[p : p + WIDTH]] > 1:
                gone[p : p + WIDTH] = b"\1" * WIDTH
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(t)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def found(spark, texts, **parameters):
    frame = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in texts], SCHEMA).repartition(5)
    return sorted([tuple(r) for r in without_repeats(frame, **parameters).select(COLUMNS).collect()], key=str)


def passages(seed):
    """Passages of many sizes around the width in surroundings of their own, periodic texts, letters of several bytes."""
    draw = random.Random(seed)
    letters = lambda n, of="abcdefgh \n": "".join(draw.choice(of) for _ in range(n))
    texts = []
    for size in (150, 198, 199, 200, 201, 260, 900):
        passage = letters(size)
        texts += [letters(draw.randrange(150)) + passage + letters(draw.randrange(150)) for _ in range(6)]
    once = letters(700)
    texts += [once + "x" + once, "ab" * 300, "ab" * 99 + "a", "ab" * 100, "c" * 450, "äöü€😀" * 60, "äöü€😀" * 40 + "z"]
    texts += [once[:350] + draw.choice("xyz") + once[351:] for _ in range(5)]
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    texts = [(i, t[:6000] if t else t) for i, t in family_corpus().items()]
    assert found(spark, texts) == brute(texts)


def test_passages_by_both_ways(spark):
    texts = passages(3)
    want = brute(texts)
    assert found(spark, texts) == want
    assert found(spark, texts, members=2) == want
    assert any(r[2] == 0 for r in want) and any(r[3] > 1 for r in want)


def test_odd_rows(spark):
    long = "".join(random.Random(5).choice("abcd ") for _ in range(500))
    texts = [(1, None), (2, ""), (3, "short"), (4, long), (4, long), (5, long[100:320]), (None, long[50:]), (None, None), (4, "other")]
    assert found(spark, texts) == brute(texts)
    assert found(spark, []) == []


def test_a_long_text(spark):
    draw = random.Random(9)
    long = "".join(draw.choice("abcdefghijklmnop ") for _ in range(60_000))
    texts = [(1, long), (2, long[30_000:30_400]), (3, long[:300] + long[40_000:40_300])]
    assert found(spark, texts) == brute(texts)
