import random
import re

import numpy as np

from catalake.llm.pii import BASE, base_spans, digest, find_spans, luhn, reliabilities
from tests.llm.corpora import SCHEMA, rows

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def test_base_spans_equal_the_patterns():
    draw = random.Random(9)
    parts = ["a", "b@c.de", "@", ".", "x.y-z@q-r.s.t", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (212) 555-0100",
             " ", "-", "12", "0", "+", "(", "é", "\n", "_", "%", "4111111111111111", "."]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(12)))
        assert base_spans(text) == plain(text), text


def test_luhn():
    assert luhn("4111111111111111") and luhn("79927398713") and not luhn("4111111111111112")


def test_long_runs_are_linear():
    for text in ("1" * 100_000, "a" * 100_000, "a@" * 50_000, "1." * 50_000, "+1" + " " * 100_000, "x@a" + ".b" * 50_000):
        base_spans(text)


def test_spans_of_a_table(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = {i: f"reach me at user{i}@mail.example.com or not" for i in range(20)}
    texts |= {100 + i: f'config token = "{i:04d}9f86d081884c7d659a2feaa0c55ad015a3bf4f" end' for i in range(30)}
    texts |= {200 + i: f"key {key} and more words" for i in range(10)}
    texts |= {300 + i: "| 1234567 | 2345678 | 3456789 | 4567890 |" for i in range(20)}
    texts |= {400: None, 401: "", 402: "plain words only", 403: texts[0]}
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    found = {r["id"]: r for r in find_spans(docs).select("id", "spans", digest("spans").alias("line")).collect()}
    assert len(found) == len(texts)
    for key_, text in texts.items():
        base = [tuple(s)[:3] for s in found[key_]["spans"] if s["kind"] in BASE]
        assert base == plain(text or "")
    assert found[0]["line"] == f"email:12:{12 + len('user0@mail.example.com')}" == found[403]["line"]
    assert all(any(s["kind"] == "secret" for s in found[i]["spans"]) for i in (*range(100, 130), *range(200, 210)))
    assert not any(found[i]["spans"] for i in (*range(300, 320), 400, 401, 402))
    assert find_spans(docs.limit(0)).count() == 0


def test_reliabilities_follow_agreement():
    codes = np.array([1 * 81 + 1 * 27 + 9 + 3, 2 * 27 + 2], np.int64)  # nearly all for, and against
    p = reliabilities(codes, np.array([50, 50]))
    assert p[0] > 0.9 and p[1] < 0.1
