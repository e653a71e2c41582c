"""Small made-up corpora for the corpus operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, words string"


def prose(draw: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def changed(draw: random.Random, words: list[str], times: int) -> list[str]:
    words = list(words)
    for _ in range(times):
        words[draw.randrange(len(words))] = f"z{draw.randrange(10_000)}"
    return words


def rows(texts: dict[int, str | None]):
    """Rows with columns whose names clash with names inside the operators."""
    return [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in texts.items()]


def family_corpus(seed: int = 1) -> dict[int, str | None]:
    """Unrelated texts, exact copies, near copies at many distances, short, empty and null texts, one long text."""
    draw = random.Random(seed)
    texts: dict[int, str | None] = {}
    for _ in range(25):
        texts[len(texts)] = " ".join(prose(draw, draw.randrange(6, 120)))
    for base in range(8):
        words = prose(draw, 150)
        for copy in range(12):
            texts[len(texts)] = " ".join(changed(draw, words, copy // 2))
    texts |= {200: None, 201: "", 202: " \n\t ", 203: "one two", 204: "One  TWO", 205: "one two three", 206: "Ä b c d e",
              207: "ä b c d e", 208: " ".join(prose(draw, 20_000))}
    texts[209] = texts[208] + " end"
    return texts
