import random

import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from catalake.llm.pieces import Transducer, encode_and_decode
from tests.llm.corpora import SCHEMA, rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ODD = ["", " ", "  ", " a", "a ", "  hello  world ", "a\tb\nc\r\nd", "ﬁ Ａ é é  x", "😀 \x00 z", "<s> </s> <0x41> <unk>",
       "ä" * 50, "x" * 3000, "1234567890" * 5, "naïve café – “quoted”", "日本語 テキスト", "a" + " " * 40 + "b"]


@pytest.fixture(scope="module")
def machine():
    return Transducer(MODEL)


def random_texts(n=150):
    draw = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzeeeeaaattt" + "     ,.-äéñ0123\n" + "ABCE🙂ß"
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 120))) for _ in range(n)]


def test_shortest_path_is_the_original_encoding(machine):
    original = SentencePieceProcessor(model_file=MODEL)
    texts = ODD + random_texts()
    ids, ends = machine.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == original.encode(text), text


def test_decoding_equals_the_original(machine):
    original = SentencePieceProcessor(model_file=MODEL)
    texts = ODD + random_texts()
    data, places = machine.decode(*machine.encode(pa.array(texts)))
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(places[:-1], places[1:])] == [original.decode(original.encode(t)) for t in texts]


def test_table_with_nulls_and_clashing_names(spark):
    texts = {1: None, 2: "", 3: "Ein Satz.", 4: "Ein Satz.", 5: "▁ meta", 6: "wort " * 20_000}
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    clash = docs.withColumnRenamed("words", "n_pieces").withColumnRenamed("id", "decoded")
    found = {r["doc_id"]: r for r in encode_and_decode(clash, MODEL).collect()}
    assert found[1]["n_pieces"] == found[2]["n_pieces"] == 0 and found[1]["decoded"] == ""
    assert found[3]["piece_ids"] == found[4]["piece_ids"] and found[5]["decoded"] == "  meta"
    assert all(r["round_trip"] for r in found.values()) and found[6]["decoded"] == texts[6]
    assert encode_and_decode(docs.limit(0), MODEL).count() == 0
