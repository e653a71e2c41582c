"""Chat formatting with typed content parts.

A turn's content is an array of parts of kind text, image, audio or document. A visitor goes over the parts in order:
text is escaped, any other part becomes a numbered placeholder, and its reference and the number of tokens it expands to
are recorded. A formatted turn is ``<|turn|>role``, a line break, the content and ``<|end|>``. Escaping writes every
backslash, ``<``, ``[`` and ``]`` of roles and texts (and line breaks of roles) as a backslash and a letter, so no control
string, of this template or another's, is left in a text, and reading the pairs gives the text back.

All of it is column expressions of one row per turn. A conversation is read back by streaming its turns in order through
one task with running digests, so the memory needed does not depend on the length of a conversation.

Defined results: a null text or role is empty; turns come by number, nulls first, equal numbers by role, then text;
repeated rows count each time; unknown kinds of parts count as text; no turns give no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: What a backslash and this letter stand for.
LETTERS = {"b": "\\", "l": "<", "o": "[", "c": "]", "n": "\n"}
#: Tokens for each unit of an attachment: image tiles, seconds of audio, pages of a document.
TOKENS = {"image": 256, "audio": 25, "document": 640}
PART = "struct<kind: string, text: string, ref: string, units: double>"
_PAIR = re.compile(r"\\([blocn])")


def escaped(text: F.Column, also: str = "") -> F.Column:
    """``also`` names further letters of LETTERS whose characters are escaped."""
    out = F.coalesce(text, F.lit(""))
    for letter in "bloc" + also:
        out = F.replace(out, F.lit(LETTERS[letter]), F.lit("\\" + letter))
    return out


def text_part(text: F.Column) -> F.Column:
    """The content of a turn that is one text."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("double").alias("units"),
        )
    )


def _attached(part: F.Column) -> F.Column:
    return F.coalesce(part["kind"].isin(*TOKENS), F.lit(False))


def _tokens(part: F.Column) -> F.Column:
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in TOKENS.items() for x in pair]), part["kind"])
    return F.ceil(F.coalesce(part["units"], F.lit(1.0)) * rate).cast("long")


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, parts) with formatted, attachments and attachment_tokens.

    ``attachments`` lists kind, placeholder, ref and tokens in the order of the content.
    """
    parts = F.coalesce(F.col("parts"), F.expr(f"cast(array() as array<{PART}>)"))
    placed = F.transform(parts, lambda p, i: F.struct(p.alias("part"), i.alias("at")))
    number = lambda i: F.size(F.filter(F.slice(parts, 1, i + 1), _attached))
    mark = lambda p, i: F.concat(F.lit("<|"), p["kind"], F.lit(":"), number(i).cast("string"), F.lit("|>"))
    flat = F.transform(
        placed, lambda x: F.when(_attached(x["part"]), mark(x["part"], x["at"])).otherwise(escaped(x["part"]["text"]))
    )
    attachments = F.transform(
        F.filter(placed, lambda x: _attached(x["part"])),
        lambda x: F.struct(
            x["part"]["kind"].alias("kind"), mark(x["part"], x["at"]).alias("placeholder"),
            x["part"]["ref"].alias("ref"), _tokens(x["part"]).alias("tokens"),
        ),
    )
    role = escaped(F.col("role"), also="n")
    return (
        turns.withColumn("formatted", F.concat(F.lit(TURN), role, F.lit("\n"), F.array_join(flat, ""), F.lit(END)))
        .withColumn("attachments", attachments)
        .withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    )


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; placeholders stay as they are."""
    if not (formatted.startswith(TURN) and formatted.endswith(END)):
        raise ValueError("not a formatted turn")
    role, _, content = formatted[len(TURN) : -len(END)].partition("\n")
    plain = lambda text: _PAIR.sub(lambda pair: LETTERS[pair[1]], text)
    return plain(role), plain(content)


def loss_text(role: str, text: str) -> str:
    """What of a turn is under the loss mask."""
    return text if role == "assistant" else ""


def _digests(batches):
    current, state = None, None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def closed(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def line():
        n, turns, chars, loss, size = state
        return (current, n, turns.hexdigest(), chars, loss.hexdigest(), size)

    for batch in batches:
        rows = []
        for conv, formatted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or conv != current:
                if state is not None:
                    rows.append(line())
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_turn(formatted)
            masked = loss_text(role, text)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(masked)
            state[3].update(masked.encode())
            state[4] += len(formatted)
        if rows:
            yield closed(rows)
    if state is not None:
        yield closed([line()])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation: counts and digests of its turns and of the text under the loss mask."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.select("conv_id", "formatted").mapInArrow(
        _digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, attachments): each conversation as one text, for corpora whose conversations fit in a row."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "formatted", "attachments")))
    return formatted.groupBy("conv_id").agg(turns.alias("t")).select(
        "conv_id", F.array_join("t.formatted", "").alias("formatted"), F.flatten("t.attachments").alias("attachments")
    )
