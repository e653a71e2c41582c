import random
from collections import Counter

from catalake.llm.decontaminate import fingerprints, matches, without_contaminated
from tests.llm.corpora import SCHEMA, changed, prose, rows

ITEMS = "item_id long, text string"


def bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_force(texts, items):
    """Every window of every document, not only those that begin with a shared shingle."""
    found = {}
    for key, text in texts.items():
        w = (text or "").lower().split()
        for item, other in items.items():
            v = (other or "").lower().split()
            if not w or not v:
                continue
            b = bag(v)
            for start in range(max(1, len(w) - len(v) + 1)):
                a = bag(w[start : start + len(v)])
                score = sum((a & b).values()) / sum((a | b).values())
                if score >= 0.8 and score > found.get((key, item), (0, 0))[0]:
                    found[key, item] = (score, start)
    return found


def test_equals_brute_force(spark):
    draw = random.Random(2)
    items = {i: " ".join(prose(draw, draw.randrange(15, 60))) for i in range(12)}
    items |= {50: "just four words here", 51: None, 52: "", 53: "a b " * 20, 54: items[3]}
    texts = {}
    for i in range(40):
        words = prose(draw, draw.randrange(20, 200))
        passage = items[i % 12].split()
        at = draw.randrange(len(words))
        kind = i % 4
        inserted = passage if kind == 0 else changed(draw, passage, 1) if kind == 1 else passage[: len(passage) // 2]
        texts[i] = " ".join(words[:at] + ([] if kind == 3 else inserted) + words[at:])
    texts |= {60: None, 61: "", 62: "Just four  WORDS here", 63: items[0], 64: " ".join(items[1].split()[1:]), 65: "b a " * 40,
              66: texts[0], 67: "just four words here indeed"}
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    benchmark = spark.createDataFrame(list(items.items()), ITEMS)
    want = brute_force(texts, items)
    found = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in matches(docs, benchmark).collect()}
    assert set(found) == set(want)
    assert all(abs(found[k][0] - want[k][0]) < 1e-12 for k in want)
    left = {r["doc_id"] for r in without_contaminated(docs, benchmark).collect()}
    assert left == set(texts) - {k for k, _ in want}


def test_rows_of_one_id(spark):
    item = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "clean text of no concern at all"), (1, item), (1, item), (2, f"so {item} it goes"), (3, "a two b")],
                                 "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, item), (8, "two")], ITEMS)
    assert sorted((r["doc_id"], r["item_id"], r["start"]) for r in matches(docs, benchmark).collect()) == [(1, 9, 0), (2, 9, 1), (3, 8, 1)]
    assert [tuple(r) for r in without_contaminated(docs, benchmark).collect()] == [(1, "clean text of no concern at all")]


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], ITEMS)
    assert matches(docs, none).count() == 0 and without_contaminated(docs, none).count() == 1
    assert matches(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], ITEMS)).count() == 0


def test_fingerprint_is_the_majority_of_bits(spark):
    hashes = [0x0123456789ABCDEF, -1, 0x00FF00FF00FF00FF, 5, -(2**63)]
    row = spark.createDataFrame([(1, hashes)], "k long, shingles array<long>")
    got = fingerprints(row, ["k"]).first()["print"] & (2**64 - 1)
    want = sum(1 << b for b in range(64) if sum((h >> b) & 1 for h in hashes) * 2 > len(hashes))
    assert got == want
