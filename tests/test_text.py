import statistics
import random

import pytest
from pyspark.sql import functions as F

from catalake.functions import keys, text
from catalake.functions import vocabulary as v
from catalake.operators.group_rules import exact_medians
from catalake.operators.history import rejection_rate
from catalake.operators.report import safe_cell, short_number


def column(spark, values, use, kind="string"):
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [row[0] for row in frame.orderBy("i").select(use(F.col("x"))).collect()]


def test_whitespace_set_is_complete():
    assert set(text.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_collapse_and_fold(spark):
    samples = ["  a b ", "　A\tb\x1c c\xa0", None, "", "a  b", "one two", " ", "\n\nX\r\n"]
    plain = ["" if s is None else s for s in samples]
    assert column(spark, samples, text.strip) == [s.strip() for s in plain]
    assert column(spark, samples, text.collapse) == [" ".join(s.split()) for s in plain]
    assert column(spark, samples, text.squash) == [" ".join(s.split()).casefold() for s in plain]


def test_whole_number(spark):
    def expected(s):
        try:
            n = int(s)
        except ValueError:
            return None
        return n if -(2**63) <= n < 2**63 else None

    samples = ["5", "+5", "-3", "1_000", "1__0", "_1", "1.5", "1e3", "", "abc", "１２", "0x1", "--1", "9" * 19, "007"]
    assert column(spark, samples, text.whole_number) == [expected(s) for s in samples]


def test_leaf_name_and_suffix(spark):
    names = ["C:\\in\\a.csv", "x/y/", "/b.csv ", "", "plain"]
    assert column(spark, names, text.leaf_name) == ["a.csv", "y", "b.csv", "", "plain"]
    long = ["x" * 300 + ".csv", "y" * 300, "." + "z" * 300, "ok.csv", "a." + "b" * 300]
    cut = column(spark, long, text.shorten_keeping_suffix)
    assert cut == ["x" * 251 + ".csv", "y" * 255, "." + "z" * 254, "ok.csv", ("a." + "b" * 300)[:255]]


def test_option_keys(spark):
    sizes = ["free  size", "Free_Size", "S-M", "s-m", "10.5", "1 0", "", "XX-Large", "２", "프리 사이즈"]
    assert column(spark, sizes, keys.size_key) == ["FREE", "FREE", "s-m", "s-m", "10.5", "1 0", None, "XXL", "２", "FREE"]
    assert column(spark, sizes, keys.size_system) == [None, None, None, None, None, "NUMERIC", None, "ALPHA", None, None]
    colors = ["na-vy", "BLACK/WHITE", "검정 색", "melange  GRAY"]
    assert column(spark, colors, keys.color_key) == ["NAVY", "black/white", "BLACK", "melange gray"]


def test_vocabulary_rejects_conflicting_aliases():
    with pytest.raises(ValueError):
        v.Vocabulary(color_aliases={"na vy": "NAVY", "NA-VY": "BLUE"})


def test_exact_medians(spark):
    rng = random.Random(7)
    rows, groups = [], {}
    for group in ("a", "b", "c", "d"):
        for _ in range({"a": 1, "b": 2, "c": 999, "d": 1000}[group]):
            value = rng.choice([rng.randint(1, 50), rng.randint(1, 10**6), rng.randint(1, 2**62)])
            rows.append((group, value))
            groups.setdefault(group, []).append(value)
    frame = spark.createDataFrame(rows, "g string, x bigint")
    found = {r["g"]: (r["n"], r["median"]) for r in exact_medians(frame, ["g"], "x").collect()}
    for group, values in groups.items():
        low, high = statistics.median_low(values), statistics.median_high(values)
        assert found[group] == (len(values), (float(low) + float(high)) / 2)
    assert {r["g"] for r in exact_medians(frame, ["g"], "x", at_least=5).collect()} == {"c", "d"}


def test_rates_round_half_to_even(spark):
    frame = spark.createDataFrame([(r, t) for t in range(1, 120) for r in range(0, t + 1)], "r bigint, t bigint")
    for row in frame.select("r", "t", rejection_rate(F.col("r"), F.col("t")).alias("x")).collect():
        assert row.x == round(row.r / row.t * 100, 2)


def test_short_number_and_safe_cell(spark):
    numbers = [5.0, 4.5, 12.34, 0.12, 0.2, 123456.78, 1234567.0, 0.05, 99999.91, 100.0]
    assert column(spark, numbers, short_number, "double") == [f"{x:g}" for x in numbers]
    cells = ["=1", "+2", "-3", "@x", "'=1", "plain", "", "'"]
    assert column(spark, cells, safe_cell) == ["'=1", "'+2", "'-3", "'@x", "'=1", "plain", "", "'"]
