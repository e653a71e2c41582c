import random

import numpy as np
import pytest

from catalake.llm.toxicity import ADDED, chain_scores, counter, fit_chain, score, without_toxic
from tests.llm.corpora import SCHEMA, prose, rows

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    """Toxic: two or more bad words, or two or more words of a bad stem; one mention alone is harmless."""
    draw = random.Random(8)
    texts, toxic = {}, {}
    for i in range(900):
        words = prose(draw, draw.randrange(20, 60))
        kind = i % 6
        bad = draw.sample(["idiot", "moron", "trash", "scum"], 2) if kind == 0 else [
            f"grobl{draw.randrange(99)}x", f"grobl{draw.randrange(99)}y"] if kind == 1 else ["idiot"] if kind == 2 else []
        for word in bad:
            words.insert(draw.randrange(len(words)), word.upper() if i % 2 else word)
        texts[i], toxic[i] = " ".join(words), int(kind < 2)
    return texts, toxic


def labels_of(spark, toxic):
    return spark.createDataFrame([(i, 1, t) for i, t in toxic.items()] + [(None, 1, 1), (5, 1, None)], LABELS)


def test_held_out_accuracy(spark):
    texts, toxic = corpus()
    known = {i: t for i, t in toxic.items() if i % 5}
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    found = {r["doc_id"]: r for r in score(docs, labels_of(spark, known)).collect()}
    wrong = [i for i in toxic if i % 5 == 0 and (found[i]["p_toxic"] >= 0.5) != bool(toxic[i])]
    assert len(wrong) <= 0.03 * len(toxic) / 5
    mentions = [found[i] for i in toxic if i % 6 == 0 and "moron" in texts[i].lower()]
    assert np.mean([r["p_insult"] for r in mentions]) > 0.5 > np.mean([r["p_insult"] for r in found.values()])


def test_rejected_documents_go_and_columns_stay(spark):
    texts, toxic = corpus()
    texts |= {2000: None, 2001: "", 2002: texts[0], 2003: "fine words only " * 5000}
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    kept = without_toxic(docs, labels_of(spark, toxic))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {2000, 2001, 2003} <= ids and not {0, 2002} & ids


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "you idiot moron")], "doc_id long, text string")
    none = spark.createDataFrame([], LABELS)
    assert without_toxic(docs, none).count() == 1
    assert [r["p_toxic"] for r in score(docs, none).collect()] == [0.0]
    assert score(docs.limit(0), none).columns == ["doc_id", "text", *ADDED]


def test_counter_knows_words_and_stems():
    counts = counter(["scum$", "vequ"])(["Scum scummy vequa ävequ VEQU, scum.", None])
    assert counts.tolist() == [[2.0, 2.0], [0.0, 0.0]]


def test_chain_feeds_earlier_probabilities():
    draw = np.random.Generator(np.random.PCG64(1))
    counts = draw.integers(0, 3, (400, 3)).astype(float)
    first = (counts[:, 0] > 0).astype(float)
    second = ((counts[:, 0] > 0) & (counts[:, 1] > 0)).astype(float)
    models = fit_chain(counts, np.stack([first, second], axis=1), np.arange(400))
    assert len(models[1]) == len(models[0]) + 1
    assert ((chain_scores(models, counts) >= 0.5) == np.stack([first, second], axis=1)).mean() > 0.95


@pytest.mark.parametrize("folder, toxic, least", [("sf0.001", 11, 11), ("sf0.01", 51, 50)])
def test_recall_with_few_labels(spark, folder, toxic, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r["p_toxic"] >= 0.5 for r in score(docs.select("doc_id", "text"), labels).collect()}
    known = [(r["toxic"], found[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in found]
    assert sum(t for t, _ in known) == toxic
    assert sum(t and f for t, f in known) >= least and sum(f and not t for t, f in known) <= 1


def test_labels_of_one_class_give_a_warning(spark):
    docs = spark.createDataFrame([(1, "you idiot moron")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="1 toxic and 0 other"):
        assert without_toxic(docs, spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 1


def test_families_are_an_argument_and_empty_ones_are_reported(spark):
    texts = {i: "fine words " + ("blarg" if i % 2 else "other") for i in range(40)}
    docs = spark.createDataFrame(rows(texts), SCHEMA).select("doc_id", "text")
    labels = labels_of(spark, {i: i % 2 for i in texts})
    with pytest.warns(UserWarning, match="category rare has no positive row") as said:
        found = score(docs, labels, {"rude": ("blarg",), "rare": ("grumf",)})
    assert ["rude" in str(w.message) for w in said if "category" in str(w.message)] == [False]
    assert found.columns == ["doc_id", "text", "p_rude", "p_rare", "p_toxic"]
    assert all((r["p_rude"] > 0.5) == bool(r["doc_id"] % 2) and r["p_rare"] < 0.5 for r in found.collect())
