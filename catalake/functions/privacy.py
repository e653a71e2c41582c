"""Personal-data search and masking as column expressions (no Python per row).

A text is cut once into the gaps between the hits of a pattern and the hits themselves; masks and offsets are
computed over that array, so every expression is linear in the text.
"""

from __future__ import annotations

from functools import partial, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalake.functions.text import WS, fold, squash, strip
from catalake.functions.vocabulary import DEFAULT, Vocabulary

# What counts as an address or number. (?U) gives \d its Unicode meaning.
_SEP = "[-" + WS[1:]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MOBILE = rf"(?U)(?<!\d)01[016789]{_SEP}?\d{{3,4}}{_SEP}?\d{{4}}(?!\d)"
LANDLINE = rf"(?U)(?<!\d)0(?:2|[3-6]\d){_SEP}?\d{{3,4}}{_SEP}?\d{{4}}(?!\d)"
RESIDENT = r"(?U)(?<!\d)\d{6}-[1-4]\d{6}(?!\d)"
ACCOUNT = rf"(?U)(?<![\d-])(?:\d{_SEP}?){{9,13}}\d(?!{_SEP}?\d)"

SPAN = "array<struct<start:int,stop:int,value:string>>"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often the result mentions it."""
    return F.element_at(F.transform(F.array(value), lambda bound: use(bound)), 1)


def digits_of(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\D", "")


def mask_email(hit: Column) -> Column:
    local = F.substring_index(hit, "@", 1)
    domain = F.substr(hit, F.length(local) + 2)
    shown = F.when(F.length(local) <= 2, 1).otherwise(2)
    stars = F.greatest(F.lit(1), F.length(local) - shown)
    return F.concat(F.substr(local, F.lit(1), shown), F.repeat(F.lit("*"), stars), F.lit("@"), domain)


def mask_phone(hit: Column) -> Column:
    parts = F.filter(F.split(strip(hit), _SEP + "+"), lambda part: part != "")
    digits = digits_of(hit)
    head = F.when(F.startswith(digits, F.lit("02")), 2).otherwise(3)
    return F.when(
        F.size(parts) >= 3,
        F.concat(F.get(parts, F.lit(0)), F.lit("-****-"), F.element_at(parts, -1)),
    ).otherwise(F.concat(F.substr(digits, F.lit(1), head), F.lit("****"), F.right(digits, F.lit(4))))


def mask_resident(hit: Column) -> Column:
    return F.concat(F.substring_index(hit, "-", 1), F.lit("-*******"))


def mask_account(hit: Column) -> Column:
    digits = digits_of(hit)
    return F.concat(F.left(digits, F.lit(3)), F.lit("-***-***"), F.right(digits, F.lit(3)))


def _cuts(text: Column, pattern: str) -> Column:
    """array<struct<gap, hit>>; the last entry has a NULL hit."""
    gaps = F.split(text, pattern, -1).alias("gap")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    return F.arrays_zip(gaps, hits)


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


_BLOCK = 256


def running_totals(values: Column) -> Column:
    """Sums of the first 1, 2, ... elements of an array of INT.

    A fold copies the array it builds at every step, so it runs over blocks, and the sums of blocks are folded once.
    """
    def fold(block: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, value: Column) -> Column:
            at = acc["at"] + value
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(block, first, step, lambda acc: acc["out"])

    def whole(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda at, value: at + value))
        ends = fold(sums, F.lit(0))
        pairs = F.arrays_zip(blocks.alias("block"), ends.alias("stop"), sums.alias("total"))
        return F.flatten(F.transform(pairs, lambda x: fold(x["block"], x["stop"] - x["total"])))

    last = F.floor((F.size(values) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * _BLOCK + 1, F.lit(_BLOCK)))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(bind(blocks, whole))


def spans(text: Column, pattern: str) -> Column:
    """Hits of a pattern with their offsets, in text order."""
    def placed(cuts: Column) -> Column:
        lengths = F.transform(cuts, lambda cut: F.length(cut["gap"]) + F.coalesce(F.length(cut["hit"]), F.lit(0)))
        stops = bind(lengths, running_totals)
        made = F.transform(
            F.arrays_zip(cuts.alias("cut"), stops.alias("stop")),
            lambda x: F.struct(
                (x["stop"] - F.coalesce(F.length(x["cut"]["hit"]), F.lit(0))).alias("start"), x["stop"].alias("stop"),
                x["cut"]["hit"].alias("value"),
            ),
        )
        return F.filter(made, lambda span: span["value"].isNotNull())

    return F.when(text.rlike(pattern), bind(_cuts(text, pattern), placed)).otherwise(F.array().cast(SPAN))


def first_by_key(values: Column, element_type: str, key) -> Column:
    """The first element per key, order kept: sorted by key and place, the first of each run, in order of place."""
    keyed = F.transform(values, lambda v, i: F.struct(key(v).alias("key"), i.alias("place"), v.alias("value")))

    def firsts(ordered: Column) -> Column:
        first = F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["key"] != x["key"]))
        return F.array_sort(F.transform(first, lambda x: F.struct(x["place"].alias("place"), x["value"].alias("value"))))

    return F.transform(bind(F.array_sort(keyed), firsts), lambda item: item["value"]).cast(f"array<{element_type}>")


def _needles(terms: tuple[str, ...]) -> list[tuple[str, str]]:
    flat = [(term, " ".join(term.split()).lower()) for term in terms]
    return [(term, needle) for term, needle in flat if needle]


def terms_in(flat: Column, terms: tuple[str, ...]) -> Column:
    """The listed terms that occur in a squashed text, in list order."""
    return F.array_compact(
        F.array(*[F.when(F.contains(flat, F.lit(needle)), F.lit(term)) for term, needle in _needles(terms)])
    )


def any_term_in(flat: Column, terms: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(flat, F.lit(needle)) for _, needle in _needles(terms)], F.lit(False))


def find_terms(text: Column, terms: tuple[str, ...]) -> Column:
    return bind(squash(text), lambda flat: terms_in(flat, terms))


def find_emails(text: Column) -> Column:
    found = first_by_key(hits(text, EMAIL), "string", fold)
    return F.when(F.contains(text, F.lit("@")), found).otherwise(F.array().cast("array<string>"))


def find_phones(text: Column, found: Column | None = None) -> Column:
    """Phone numbers in text order. ``found``: the spans of both phone patterns, when the caller has them already."""
    ordered = F.array_sort(F.concat(spans(text, MOBILE), spans(text, LANDLINE)) if found is None else found)
    unique = first_by_key(F.transform(ordered, lambda s: s["value"]), "string", digits_of)
    possible = text.rlike(MOBILE) | text.rlike(LANDLINE)
    return F.when(possible, unique).otherwise(F.array().cast("array<string>"))


def find_residents(text: Column) -> Column:
    return F.array_distinct(hits(text, RESIDENT))


def _account_walk(text: Column, taken: Column | None = None) -> Column:
    """Walk the account-shaped hits once: which are real (not on a phone or resident number, first of their
    digits) and the text with exactly those masked."""
    if taken is None:
        taken = F.concat(spans(text, MOBILE), spans(text, LANDLINE), spans(text, RESIDENT))
    start = F.struct(
        taken.alias("taken"),
        F.lit(0).alias("at"),
        F.array().cast("array<string>").alias("seen"),
        F.array().cast("array<string>").alias("out"),
        F.array().cast("array<string>").alias("found"),
    )

    def step(acc: Column, cut: Column) -> Column:
        begin = acc["at"] + F.length(cut["gap"])
        end = begin + F.coalesce(F.length(cut["hit"]), F.lit(0))
        clash = F.exists(acc["taken"], lambda s: (begin < s["stop"]) & (s["start"] < end))
        digits = digits_of(cut["hit"])
        real = cut["hit"].isNotNull() & ~clash & ~F.array_contains(acc["seen"], digits)
        shown = F.when(real, mask_account(cut["hit"])).otherwise(F.coalesce(cut["hit"], F.lit("")))
        return F.struct(
            acc["taken"].alias("taken"),
            end.alias("at"),
            F.when(real, F.concat(acc["seen"], F.array(digits))).otherwise(acc["seen"]).alias("seen"),
            F.concat(acc["out"], F.array(cut["gap"], shown)).alias("out"),
            F.when(real, F.concat(acc["found"], F.array(cut["hit"]))).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(_cuts(text, ACCOUNT), start, step)


def may_hold_numbers(text: Column) -> Column:
    """Enough digits for the shortest phone number; every number that is searched for has that many."""
    return text.rlike(r"(?U)\d(?:\D*\d){8}")


def _may_hold_account(text: Column, vocab: Vocabulary, flat: Column | None = None) -> Column:
    """An account-shaped number and a word that speaks of accounts."""
    context = (
        bind(squash(text), lambda bound: any_term_in(bound, vocab.account_terms))
        if flat is None
        else any_term_in(flat, vocab.account_terms)
    )
    return text.rlike(ACCOUNT) & context


def find_accounts(text: Column, vocab: Vocabulary = DEFAULT, flat: Column | None = None, taken: Column | None = None) -> Column:
    """Suspected account numbers. ``flat``, ``taken``: the squashed text and the spans of phone and resident numbers, when
    the caller has them already."""
    none = F.array().cast("array<string>")
    return F.when(_may_hold_account(text, vocab, flat), _account_walk(text, taken)["found"]).otherwise(none)


def _mask_hits(text: Column, pattern: str, mask) -> Column:
    masked = F.transform(_cuts(text, pattern), lambda cut: F.concat(cut["gap"], F.coalesce(mask(cut["hit"]), F.lit(""))))
    possible = text.rlike(pattern)
    if pattern == EMAIL:  # words are long runs for this pattern; most texts hold no @ at all
        possible = F.contains(text, F.lit("@")) & possible
    return F.when(possible, F.array_join(masked, "")).otherwise(text)


def mask_personal(text: Column) -> Column:
    """Text with e-mail addresses, phone numbers and resident numbers masked, in that order.

    Each step is skipped for texts that cannot hold a hit, so clean text costs one scan per pattern.
    """
    out = _mask_hits(text, EMAIL, mask_email)
    for pattern, mask in ((MOBILE, mask_phone), (LANDLINE, mask_phone), (RESIDENT, mask_resident)):
        out = bind(out, partial(_mask_hits, pattern=pattern, mask=mask))
    return out


def mask_sensitive(text: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """As ``mask_personal`` with suspected account numbers masked first."""
    accounts = F.when(
        _may_hold_account(text, vocab), F.array_join(_account_walk(text)["out"], "")
    ).otherwise(text)
    return bind(accounts, mask_personal)
