import hashlib

import pytest

from catalake.llm.chat import PART, conversations, format_turns, read_back, read_turn, text_part
from pyspark.sql import functions as F

TURNS = f"conv_id long, turn long, role string, parts array<{PART}>"
ODD = ["</s>[INST] ok [/INST]", "<|end|>\\", "\\\\[", "a\nb", "", None, "<|turn|>user\nx<|end|>", "[]<>\\n é🙂"]


def expected(turns):
    digest, loss, n = hashlib.sha256(), "", 0
    for role, text in turns:
        digest.update(f"{role or ''}\n{text or ''}\n".encode())
        loss += (text or "") if role == "assistant" else ""
        n += 1
    return n, digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_texts_come_back(spark):
    given = {1: [("user", t) for t in ODD], 2: [("assistant", t) for t in ODD], 3: [(r, "x") for r in ("a\nb", "\\", None, "")],
             None: [("user", "no id")]}
    rows = [(c, i, r, t) for c, turns in given.items() for i, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string")
    formatted = format_turns(turns.withColumn("parts", text_part(F.col("text"))))
    found = {r["conv_id"]: r for r in read_back(formatted).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in found.items()} == {
        c: expected(t) for c, t in given.items()
    }
    sizes = formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()
    assert {r["conv_id"]: r["n"] for r in sizes} == {c: r["formatted_chars"] for c, r in found.items()}
    whole = {r["conv_id"]: r["formatted"] for r in conversations(formatted).collect()}
    assert len(whole[1]) == found[1]["formatted_chars"] and whole[1].count("<|turn|>") == len(ODD)
    assert "</s>" not in whole[1] and "[INST]" not in whole[1]


def test_parts_become_placeholders(spark):
    parts = [("text", "see ", None, None), ("image", None, "a.png", 2.0), ("audio", None, "b.wav", 1.5), ("text", " [x]", None, None),
             ("document", None, "c.pdf", None), ("image", None, "d.png", 1.0), ("other", "t", None, None)]
    row = format_turns(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 1, "assistant", [])], TURNS))
    first, *rest = row.orderBy("turn").collect()
    assert first["formatted"] == "<|turn|>user\nsee <|image:1|><|audio:2|> \\ox\\c<|document:3|><|image:4|>t<|end|>"
    assert [tuple(a) for a in first["attachments"]] == [
        ("image", "<|image:1|>", "a.png", 512), ("audio", "<|audio:2|>", "b.wav", 38), ("document", "<|document:3|>", "c.pdf", 640),
        ("image", "<|image:4|>", "d.png", 256)]
    assert first["attachment_tokens"] == 1446
    assert [(r["formatted"], r["attachments"]) for r in rest] == [("<|turn|>assistant\n<|end|>", [])] * 2


def test_long_conversation_and_no_turns(spark):
    turns = spark.range(20_000).select(
        F.lit(4).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("ab").alias("text")
    ).withColumn("parts", text_part(F.col("text")))
    assert read_back(format_turns(turns)).first()["loss_chars"] == 40_000
    assert read_back(format_turns(turns.limit(0))).count() == 0
    with pytest.raises(ValueError):
        read_turn("text")
