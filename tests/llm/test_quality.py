import random
import zlib

import pyarrow as pa

from catalake.llm.quality import FEATURES, features, score
from tests.llm.corpora import SCHEMA, prose, rows

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    draw = random.Random(3)
    texts, good = {}, {}
    for i in range(600):
        words = prose(draw, draw.randrange(20, 80))
        kind = i % 4
        texts[i] = (" ".join(words).capitalize() + ".", " ".join(words) + ", and more.", " ".join(w + "$$#" for w in words),
                    " ".join([words[0]] * 60))[kind]
        good[i] = int(kind < 2)
    return texts, good


def test_held_out_accuracy_and_labels(spark):
    texts, good = corpus()
    texts |= {1000: None, 1001: "", 1002: texts[0], 1003: "word " * 50_000}
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    labels = spark.createDataFrame([(i, g, 0) for i, g in good.items()] + [(None, 1, 0), (3, None, 0)], LABELS)
    found = {r["id"]: r for r in score(docs, labels).collect()}
    assert len(found) == len(texts)
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [i for i in good if found[i]["held_out"]]
    assert sum(found[i]["predicted"] == good[i] for i in held) >= 0.97 * len(held)
    assert found[1000]["score"] == found[1001]["score"] and found[1002]["score"] == found[0]["score"]
    # held-out labels don't matter
    turned = spark.createDataFrame([(i, 1 - g if found[i]["held_out"] else g, 0) for i, g in good.items()], LABELS)
    assert {r["id"]: r["score"] for r in score(docs, turned).collect()} == {i: r["score"] for i, r in found.items()}


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], LABELS)
    assert {(r["id"], r["held_out"], r["score"]) for r in score(docs, none).collect()} == {(1, False, 0.5), (None, False, 0.5)}
    assert score(docs.limit(0), none).count() == 0


def test_features_of_odd_texts():
    x = features(pa.array(["", None, "a", "\n\n", "same\nsame\nother", "ÄÖ"]))
    assert x.shape == (6, len(FEATURES)) and (x[0] == x[1]).all()
    assert x[4, FEATURES.index("distinct_lines")] < 1 and (x == x).all()


def test_every_labelled_document_is_fitted(spark):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefgABC.,", k=draw.randrange(1, 14))) for _ in range(500)]
    texts = {i: " ".join(draw.choices(words, k=draw.randrange(20, 50))) + "!" * draw.randrange(3) for i in range(20_000)}
    good = {i: int(("!" in t) != (draw.random() < 0.2)) for i, t in texts.items()}
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    labels = spark.createDataFrame([(i, g, 0) for i, g in good.items()], LABELS)
    known = [r for r in score(docs, labels).collect() if not r["held_out"]]
    assert len(known) > 15_000
    assert len({r["score"] for r in known}) > 0.9 * len(known)
    # the threshold is the share labelled good of all labelled documents, not of some
    assert abs(sum(r["predicted"] for r in known) - sum(good[r["id"]] for r in known)) <= 2


def test_few_of_one_label_and_copies_of_one_text(spark):
    draw = random.Random(9)
    texts = {i: " ".join(prose(draw, 12)) + "." for i in range(3000)} | {i: "$$ ## $$" for i in range(3000, 3400)}
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i in texts], LABELS)
    first = {r["id"]: (r["score"], r["predicted"]) for r in score(docs, labels).collect()}
    assert sum(p == int(i < 3000) for i, (_, p) in first.items()) >= 0.99 * len(first)
    again = score(docs.repartition(3, "text"), labels.repartition(2))
    assert {r["id"]: (r["score"], r["predicted"]) for r in again.collect()} == first
