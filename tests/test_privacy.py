"""Search and masking: written-out cases, and properties that hold on random texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from catalake.functions import privacy
from catalake.operators.scan import mask_source_map

# text -> what mask_personal gives
PERSONAL = {
    "": "",
    "plain text": "plain text",
    "a@b.co": "a*@b.co",
    "ab@b.co": "a*@b.co",
    "write to John.Doe@ex.com now": "write to Jo******@ex.com now",
    "x_y@z.org and q@w.com": "x_*@z.org and q*@w.com",
    "no@dots": "no@dots",
    "010-1234-5678": "010-****-5678",
    "010 1234 5678": "010-****-5678",
    "01012345678": "010****5678",
    "call 02-123-4567.": "call 02-****-4567.",
    "021234567": "02****4567",
    "031 123 4567": "031-****-4567",
    "0311234567": "031****4567",
    "9010-1234-5678": "9010-1234-5678",
    "010-1234-56789": "010-1234-56789",
    "012-1234-5678": "012-1234-5678",
    "900101-1234567": "900101-*******",
    "900101-5234567": "900101-5234567",
    "1900101-1234567": "1900101-1234567",
    "a@b.co 010-1234-5678 900101-1234567": "a*@b.co 010-****-5678 900101-*******",
}
# text -> what mask_sensitive gives (account numbers too, where the text speaks of accounts)
SENSITIVE = {
    "계좌 123-456-789012": "계좌 123-***-***012",
    "입금 110 234 567890 은행": "입금 110-***-***890 은행",
    "123-456-789012": "123-456-789012",
    "계좌 12345": "계좌 12345",
    "계좌 123456789012345": "계좌 123456789012345",
    "계좌 010-1234-5678": "계좌 010-****-5678",
    "계좌 900101-1234567": "계좌 900101-*******",
    "계좌 1-2-3-4-5-6-7-8-9-0": "계좌 123-***-***890",
    "은행 12345678901234, a@b.co": "은행 123-***-***234, a*@b.co",
}
# text -> (e-mail addresses, phone numbers, resident numbers, account numbers), first of each kind of value only
FOUND = {
    "none": ([], [], [], []),
    "A@b.co a@B.co c@d.org": (["A@b.co", "c@d.org"], [], [], []),
    "010-1234-5678 01012345678 02-123-4567": ([], ["010-1234-5678", "02-123-4567"], [], []),
    "900101-1234567 900101-1234567": ([], [], ["900101-1234567"], []),
    "계좌 123-456-789012, 123456789012": ([], [], [], ["123-456-789012"]),
    "계좌 123-456-789012 010-1234-5678": ([], ["010-1234-5678"], [], []),
    "송금 10987654321 / 110-234-567890": ([], [], [], ["10987654321", "110-234-567890"]),
}


def column(spark, texts, use):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["x"] for r in frame.select("i", use(F.col("t")).alias("x")).orderBy("i").collect()]


def test_masked_texts(spark):
    assert dict(zip(PERSONAL, column(spark, PERSONAL, privacy.mask_personal))) == PERSONAL
    assert dict(zip(SENSITIVE, column(spark, SENSITIVE, privacy.mask_sensitive))) == SENSITIVE
    maps = column(spark, SENSITIVE, lambda t: mask_source_map(F.create_map(F.lit("k"), t)))
    assert maps == [{"k": x} for x in SENSITIVE.values()]


@pytest.mark.parametrize("place, find", list(enumerate(
    [privacy.find_emails, privacy.find_phones, privacy.find_residents, privacy.find_accounts]
)))
def test_found_values(spark, place, find):
    assert dict(zip(FOUND, column(spark, FOUND, find))) == {text: kinds[place] for text, kinds in FOUND.items()}


def random_texts(n=400):
    draw = random.Random(23)
    parts = ["mail me@home.net ", "010-2222-3333 ", "계좌 ", "12345678901 ", "880808-2345678 ", "text ", "7", "-", "@", "\xa0", "\n"]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(8))) for _ in range(n)]


def test_properties_of_masking(spark):
    """Masking again changes nothing, keeps what is no number or address, and leaves nothing to be found."""
    texts = random_texts()
    once = column(spark, texts, privacy.mask_sensitive)
    assert column(spark, once, privacy.mask_personal) == once
    assert not any(column(spark, once, privacy.find_residents))
    assert not any(column(spark, once, privacy.find_phones))
    letters = lambda s: [c for c in s if "가" <= c <= "힣" or c == "\n"]
    assert all(letters(a) == letters(b) for a, b in zip(texts, once))
    digits = lambda s: sum(c.isdigit() for c in s)
    assert all(digits(b) <= digits(a) for a, b in zip(texts, once))


def test_a_text_full_of_numbers_takes_seconds(spark):
    hits = 100_000
    text = "계좌 " + " / ".join(f"010-{i // 10_000:04d}-{i % 10_000:04d}" for i in range(hits))
    began = time.monotonic()
    masked, found = column(spark, [text], lambda t: F.array(F.length(privacy.mask_personal(t)), F.size(privacy.find_phones(t))))[0]
    assert masked == len(text) and found == hits
    assert time.monotonic() - began < 60


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([("x",)], "t string").select(privacy.mask_sensitive(F.col("t")).alias("m"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
