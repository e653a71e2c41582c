"""Personal data in texts: exact base spans, and further spans by weak supervision.

Base kinds follow fixed patterns (leftmost, non-overlapping per kind; a match that fails its test is dropped, not tried
again). Further candidates (key-like strings and other number groups) get votes from regex, gazetteer and context
labelers: personal, harmless or abstain. Expectation-maximisation over the counts of all vote patterns of the corpus
estimates how far each labeler can be relied on; the posteriors train a logistic span classifier on votes and shape.
Candidates with a probability of one half or more are added. The driver sees pattern counts only, of which there are at
most ``PATTERNS`` whatever the size of the corpus.

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive; rows are kept as they come,
repeated ones too; a corpus without candidates adds nothing; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalake.llm.linear import fit_logistic, sigmoid
from catalake.llm.shared import written

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number")
LABELERS = ("shape", "mixture", "gazetteer", "assignment", "neighbours")
PATTERNS = len(ADDED) * 3 ** len(LABELERS)

# The base patterns.
_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_KEYLIKE = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,64}[0-9])[A-Za-z0-9_+/-]{12,}(?![A-Za-z0-9_+/-])")
_NUMBER = re.compile(r"(?<![A-Za-z0-9])[0-9](?:[ .()/-]{0,2}[0-9]){6,18}(?![A-Za-z0-9])")
_SECRET_SHAPE = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|[0-9a-f]{16,}")
_NUMBER_SHAPE = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
_SECRET_WORDS = re.compile(r"password|passwd|secret|token|api[ _-]?key|credential|bearer", re.I)
_NUMBER_WORDS = re.compile(r"\b(?:phone|tel|mobile|fax|call|ssn|account|passport|iban|id)\b", re.I)
_ASSIGNED = re.compile(r"[=:]\s*[\"']?$")
_BEFORE = 24


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every address has one "@"; the local part is the whole run before it, back to the end of the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", *s) for s in emails(text)]
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """One vote per labeler: 0 abstains, 1 personal, 2 harmless."""
    body, before = text[start:end], text[max(0, start - _BEFORE) : start]
    if kind == "secret":
        shape = 1 if _SECRET_SHAPE.fullmatch(body) else 0
        kinds = sum((any(c.islower() for c in body), any(c.isupper() for c in body), any(c.isdigit() for c in body)))
        digits = sum(c.isdigit() for c in body)
        mixture = 1 if kinds >= 2 and digits >= 3 else 2
        words, assigned = _SECRET_WORDS.search(before + body), _ASSIGNED.search(before)
    else:
        shape = 1 if _NUMBER_SHAPE.fullmatch(body) else 0
        mixture = 0 if 7 <= sum(c.isdigit() for c in body) <= 15 else 2
        words, assigned = _NUMBER_WORDS.search(before), re.search(r"[:#]\s*$", before)
    around = text[end : end + _BEFORE]
    tabular = sum(c.isdigit() or c in "|,;\t" for c in before + around)
    return (shape, mixture, 1 if words else 0, 1 if assigned else 0, 2 if tabular > _BEFORE // 2 else 0)


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Key-like strings and number groups outside the base spans."""
    if not _DIGIT.search(text):
        return
    ranges = sorted((s, e) for _, s, e in taken)
    for kind, pattern in (("secret", _KEYLIKE), ("number", _NUMBER)):
        at = 0
        for m in pattern.finditer(text):
            start, end = m.span()
            while at < len(ranges) and ranges[at][1] <= start:
                at += 1
            if not (at < len(ranges) and ranges[at][0] < end):
                if kind == "number" or not m[0].replace("-", "").isdigit():
                    yield kind, start, end


def _code(kind: str, cast: tuple[int, ...]) -> int:
    code = ADDED.index(kind)
    for vote in cast:
        code = code * 3 + vote
    return code


def _decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(votes, kind) of pattern codes."""
    cast = np.empty((len(codes), len(LABELERS)), np.int64)
    for place in reversed(range(len(LABELERS))):
        cast[:, place] = codes % 3
        codes = codes // 3
    return cast, codes


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior probability that a pattern is personal: Dawid-Skene with a symmetric prior, per kind."""
    cast, kinds = _decode(codes)
    posterior = np.empty(len(codes))
    for kind in np.unique(kinds):
        own = kinds == kind
        v, n = cast[own], counts[own].astype(float)
        p = np.clip(0.5 + 0.2 * ((v == 1).sum(axis=1) - (v == 2).sum(axis=1)), 0.05, 0.95)
        for _ in range(rounds):
            share = (n @ p + 1) / (n.sum() + 2)
            log = np.full(len(p), np.log(share / (1 - share)))
            for place in range(v.shape[1]):
                for vote in (0, 1, 2):
                    here = v[:, place] == vote
                    # a labeler votes rightly more often than not: the prior counts lean that way
                    lean = {0: (1.0, 1.0), 1: (2.0, 0.5), 2: (0.5, 2.0)}[vote]
                    if_true = (n[here] @ p[here] + lean[0]) / (n @ p + 3.5)
                    if_false = (n[here] @ (1 - p[here]) + lean[1]) / (n @ (1 - p) + 3.5)
                    log[here] += np.log(if_true / if_false)
            p = sigmoid(log)
        posterior[own] = p
    return posterior


def train(codes: np.ndarray, counts: np.ndarray) -> dict[int, float]:
    """Probability by pattern code from the final classifier, fitted to the posteriors."""
    if not len(codes):
        return {}
    soft = reliabilities(codes, counts)
    x = _features(codes)
    weight = np.sqrt(counts.astype(float))
    both = np.concatenate([x, x])
    target = np.concatenate([np.ones(len(x)), np.zeros(len(x))])
    w = fit_logistic(both, target, np.concatenate([weight * soft, weight * (1 - soft)]), penalty=0.05)
    return dict(zip(codes.tolist(), sigmoid(x @ w).tolist(), strict=True))


def _features(codes: np.ndarray) -> np.ndarray:
    cast, kinds = _decode(codes)
    own = [np.ones(len(codes)), kinds.astype(float)]
    for place in range(cast.shape[1]):
        own += [(cast[:, place] == 1).astype(float), (cast[:, place] == 2).astype(float)]
    strong = (cast == 1).sum(axis=1)
    return np.stack([*own, (strong >= 2).astype(float)], axis=1)


def _scan(batches):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("code", pa.int64())]))
    for batch in batches:
        found = []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            rows = [(k, s, e, -1) for k, s, e in base]
            rows += [(k, s, e, _code(k, votes(k, text, s, e))) for k, s, e in candidates(text, base)]
            found.append([dict(zip(("kind", "start", "end", "code"), r, strict=True)) for r in rows])
        yield pa.record_batch([batch.column(0), pa.array(found, span)], names=["id", "spans"])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): array of (kind, start, end, score) by kind as listed, then start; base spans score 1."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, spans array<struct<kind: string, start: long, end: long, code: long>>"
    found = written(texts.mapInArrow(_scan, schema), "spans")
    rows = (
        found.select(F.explode("spans.code").alias("code")).filter("code >= 0").groupBy("code").count().collect()
    )  # one row per pattern: at most PATTERNS
    rows.sort(key=lambda r: r["code"])
    model = train(np.array([r["code"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64))
    score = F.create_map(*[F.lit(x) for pair in ({-1: 1.0} | model).items() for x in pair]) if model else None
    kept = F.transform(
        F.filter("spans", lambda s: (s["code"] < 0) if score is None else (score[s["code"]] >= 0.5)),
        lambda s: F.struct(
            F.array_position(F.array(*map(F.lit, BASE + ADDED)), s["kind"]).alias("place"), s["start"].alias("start"),
            s["end"].alias("end"), s["kind"].alias("kind"),
            (F.lit(1.0) if score is None else score[s["code"]]).alias("score"),
        ),
    )
    return found.select(
        "id",
        F.transform(
            F.array_sort(kept),
            lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                               s["score"].alias("score")),
        ).alias("spans"),
    )


def digest(spans) -> F.Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
