"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from catalake.llm import variants

SCHEMA = "doc_id long, text string, word string, n long, classes string, tile string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(texts):
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(spark, texts):
    frame = spark.createDataFrame([(i, t, "w", 1, "c", "t") for i, t in texts], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in variants.variants(frame).collect())


def corpus(seed, words=120, docs=600):
    """Families of words at one and two edits, anagrams, letters beyond ASCII, very different counts."""
    draw = random.Random(seed)
    letters = "abcdeéÀÿ÷zA"
    vocabulary = ["".join(draw.choice(letters) for _ in range(draw.randrange(4, 9))) for _ in range(words)]
    for word in list(vocabulary):
        at = draw.randrange(len(word))
        vocabulary += [word[:at] + word[at + 1 :], word[:at] + draw.choice(letters) + word[at:], word[:at] + draw.choice(letters) + word[at + 1 :],
                       "".join(draw.sample(word, len(word)))]
    weights = [draw.paretovariate(1.0) for _ in vocabulary]
    return [(i, draw.choice([" ", "-", "1"]).join(draw.choices(vocabulary, weights, k=draw.randrange(60)))) for i in range(docs)]


def test_equals_brute_force(spark):
    texts = corpus(1)
    want = brute(texts)
    assert found(spark, texts) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] not in (None, r[2]) for r in want) and any(r[4] > 2 for r in want)


def test_blocks_over_several_tiles(spark, monkeypatch):
    texts = corpus(2)
    monkeypatch.setattr(variants, "TILE", 2_000)
    assert found(spark, texts) == brute(texts)


def test_odd_rows(spark):
    long = "x" * 5_000
    texts = [(1, None), (2, ""), (None, "apple Apple apples applé"), (3, "apple apples ÀPPLE"), (3, "apple apples ÀPPLE"), (3, "ÀPPLE 12 ÀPPLE"),
             (4, f"{long} {long} {long} {long}y {long}y {long}y"), (5, " ".join(["word" * 2_000 + "s"] * 3 + ["word" * 2_000] * 9))]
    assert found(spark, texts) == brute(texts)
    assert found(spark, []) == [] and found(spark, [(1, "one two")]) == []
