"""Comparison keys shared by the inspection rules. All are pure column expressions.

Inputs are texts of a typed catalog, that is without surrounding white space (see ``load_catalog``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalake.functions.text import WS, alias_form, collapse, fold, squash
from catalake.functions.vocabulary import DEFAULT, Vocabulary, alias_key, lookup_in

# Joins the parts of a composed key; collapsed text never contains it (it counts as white space).
PART_SEPARATOR = "\x1f"


def name_key(name: Column) -> Column:
    """Product name reduced to ASCII digits, ASCII letters and Hangul."""
    return F.regexp_replace(fold(name), "[^0-9a-z가-힣ㄱ-ㅎㅏ-ㅣ]", "")


def has_name_key(name: Column) -> Column:
    """Whether ``name_key`` is not empty, without building it."""
    return fold(name).rlike("[0-9a-z가-힣ㄱ-ㅎㅏ-ㅣ]")


def option_key(value: Column) -> Column:
    return fold(value)


def category_key(category: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """Semantic category: known aliases share one key, other texts stand for themselves, blank is ''."""
    plain = fold(category)
    return F.coalesce(lookup_in(vocab.category_aliases, plain), plain)


def keyword_text(name: Column) -> Column:
    """Product name prepared for the keyword search."""
    return collapse(F.regexp_replace(fold(name), "[-_/]+", " "))


def _standard(value: Column, aliases: dict[str, str]) -> Column:
    return lookup_in({alias_key(spelling): std for spelling, std in aliases.items()}, alias_form(value))


def standard_color(value: Column, vocab: Vocabulary = DEFAULT) -> Column:
    return _standard(value, vocab.color_aliases)


def standard_size(value: Column, vocab: Vocabulary = DEFAULT) -> Column:
    return _standard(value, vocab.size_aliases)


def size_system(value: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """'ALPHA', 'NUMERIC' or NULL."""
    return (
        F.when(standard_size(value, vocab).isin(*vocab.alpha_sizes), F.lit("ALPHA"))
        .when(F.regexp_replace(value, WS, "").rlike(r"\A[0-9]+\z"), F.lit("NUMERIC"))
    )


def color_key(value: Column, vocab: Vocabulary = DEFAULT) -> Column:
    text = collapse(value)
    return F.when(text != "", F.coalesce(standard_color(text, vocab), fold(text)))


def size_key(value: Column, vocab: Vocabulary = DEFAULT) -> Column:
    text = collapse(value)
    return F.when(text != "", F.coalesce(standard_size(text, vocab), fold(text)))


def variant_size_key(category: Column, size: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """Size key, with '' standing for a blank size where the category does not need one."""
    return F.coalesce(size_key(size, vocab), F.when(category.isin(*vocab.size_optional), F.lit("")))


def field_required(category: Column, field: str, vocab: Vocabulary = DEFAULT) -> Column:
    """Whether a field must be filled for this exact category value."""
    return ~category.isin(*vocab.size_optional) if field == "size" else F.lit(True)


def comparable(vocab: Vocabulary = DEFAULT) -> Column:
    """Whether a product (columns of a typed catalog) is complete enough to compare its content."""
    c = F.col
    return (
        (c("product_group_id") != "") & (c("product_id") != "") & (c("product_name") != "")
        & c("category").isin(*vocab.categories) & (c("color") != "")
        & ((c("size") != "") | ~field_required(c("category"), "size", vocab))
        & (c("price") > 0)
    )


def content_key(vocab: Vocabulary = DEFAULT) -> Column:
    """Key of a complete product, NULL when it cannot be compared."""
    parts = [squash(F.col(name)) for name in ("product_name", "category", "color", "size")]
    return F.when(comparable(vocab), F.concat_ws(PART_SEPARATOR, *parts, F.col("price").cast("string")))
