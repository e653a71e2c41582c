"""Inspection rules that look at one product at a time.

Most rules are columns of type ``array<finding>``, evaluated together in one scan and exploded once; the text scan works on
rows of its own, one for each text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalake.functions import keys, privacy
from catalake.functions.text import squash
from catalake.functions.vocabulary import REQUIRED_TEXT_FIELDS, SCANNED_FIELDS, Vocabulary

@dataclass(frozen=True)
class RowRule:
    """A rule has ``findings``, an array column evaluated together with those of other rules, or ``rows`` of its own.

    ``steps`` are layers of named columns the findings refer to; a value used often is computed once there.
    """

    name: str
    position: int  # place of the rule in the result order
    findings: Callable[[Vocabulary], Column] | None = None
    steps: tuple[Callable[[Vocabulary], dict[str, Column]], ...] = ()
    rows: Callable[[DataFrame, list[str], Vocabulary], DataFrame] | None = None


def finding(rule: str, severity: str, message: Column | str, **args: Column) -> Column:
    pairs: list[Column] = []
    for name, value in args.items():
        pairs += [F.lit(name), value.cast("string")]
    arguments = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        arguments.cast("map<string,string>").alias("args"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
    )


def say(template: str, *values: Column) -> Column:
    """Text with ``{}`` replaced by column values (NULL-free inputs)."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, tail in zip(values, parts[1:], strict=True):
        out += [value.cast("string"), F.lit(tail)]
    return F.concat(*out)


def _at_most_one(*branches: tuple[Column, Column]) -> Column:
    chain = F.when(*branches[0])
    for condition, value in branches[1:]:
        chain = chain.when(condition, value)
    return F.array_compact(F.array(chain))


def missing_fields(vocab: Vocabulary) -> Column:
    found = [
        F.when(
            (F.col(name) == "") & keys.field_required(F.col("category"), name, vocab),
            finding("missing_required_field", "error", f"'{name}' is missing", field=F.lit(name)),
        )
        for name in REQUIRED_TEXT_FIELDS
    ]
    return F.array_compact(F.array(*found))


def _standard_values(vocab: Vocabulary) -> dict[str, Column]:
    return {
        "_standard_color": keys.standard_color(F.col("color"), vocab),
        "_standard_size": keys.standard_size(F.col("size"), vocab),
    }


def _non_standard(rule: str, field: str) -> Column:
    value, standard = F.col(field), F.col(f"_standard_{field}")
    hit = finding(
        rule, "warning", say(field + " '{}' should be standardized to '{}'", value, standard),
        value=value, standard=standard,
    )
    return _at_most_one(((value != "") & (standard != value), hit))


def non_standard_color(vocab: Vocabulary) -> Column:
    return _non_standard("non_standard_color", "color")


def non_standard_size(vocab: Vocabulary) -> Column:
    return _non_standard("non_standard_size", "size")


def invalid_category(vocab: Vocabulary) -> Column:
    value = F.col("category")
    allowed = "[" + ", ".join(f"'{name}'" for name in sorted(vocab.categories)) + "]"
    hit = finding("invalid_category", "error", say("category '{}' is not one of " + allowed, value), value=value)
    return _at_most_one(((value != "") & ~value.isin(*vocab.categories), hit))


def stock(vocab: Vocabulary) -> Column:
    value = F.col("stock")
    return _at_most_one(
        (value.isNull(), finding("invalid_stock", "error", "stock is missing or not a number")),
        (value < 0, finding("invalid_stock", "error", say("stock {} is negative", value), value=value)),
        (value == 0, finding("out_of_stock", "warning", "stock is 0")),
    )


def price(vocab: Vocabulary) -> Column:
    value = F.col("price")
    return _at_most_one(
        (value.isNull(), finding("invalid_price", "error", "price is missing or not a number")),
        (
            value <= 0,
            finding("invalid_non_positive_price", "error", say("price {} is not positive", value), value=value),
        ),
    )


def sale_price(vocab: Vocabulary) -> Column:
    value, base = F.col("sale_price"), F.col("price")
    given = F.col("sale_price_provided") | value.isNotNull()
    return _at_most_one(
        (
            given & value.isNull(),
            finding("invalid_sale_price", "error", "sale_price is missing or not a number"),
        ),
        (
            given & (value <= 0),
            finding(
                "invalid_non_positive_sale_price", "error", say("sale_price {} is not positive", value), value=value
            ),
        ),
        (
            given & (base > 0) & (value > base),
            finding(
                "sale_price_greater_than_price", "error",
                say("sale_price {} is greater than price {}", value, base), value=value, price=base,
            ),
        ),
    )


def _joined_name(vocab: Vocabulary) -> dict[str, Column]:
    # Dropping blanks from name and keyword covers the spaced and the joined spelling in one test.
    joined = F.replace(keys.keyword_text(F.col("product_name")), F.lit(" "), F.lit(""))
    return {"_joined_name": joined, "_category_key": keys.category_key(F.col("category"), vocab)}


def _implied_categories(vocab: Vocabulary) -> dict[str, Column]:
    first_hits = []
    for category, words in vocab.category_keywords.items():
        chain = F
        for word in words:
            needle = word.lower().translate({ord(ch): None for ch in "-_/ "})
            hit = F.struct(F.lit(category).alias("category"), F.lit(word).alias("keyword"))
            chain = chain.when(F.contains(F.col("_joined_name"), F.lit(needle)), hit)
        first_hits.append(chain)
    return {"_implied": F.array_compact(F.array(*first_hits))}


def category_mismatch(vocab: Vocabulary) -> Column:
    current, implied = F.col("_category_key"), F.col("_implied")
    only = F.get(implied, F.lit(0))
    hit = finding(
        "product_category_mismatch", "warning",
        say(
            "product_name keyword '{}' implies category '{}' but current category is '{}'",
            only["keyword"], only["category"], current,
        ),
        keyword=only["keyword"], implied=only["category"], current=current,
    )
    return _at_most_one(((current != "") & (F.size(implied) == 1) & (only["category"] != current), hit))


#: More than the hits that a field can have (a text has less than 2^31 characters), so that fields keep their order.
_HITS_PER_FIELD = 1 << 29

_SCANS = (
    ("prohibited_term", "error", "prohibited term", lambda v: v),
    ("email_address", "error", "email address", privacy.mask_email),
    ("phone_number", "error", "phone number", privacy.mask_phone),
    ("resident_registration_number", "error", "resident registration number", privacy.mask_resident),
    ("suspected_bank_account", "warning", "suspected bank account", privacy.mask_account),
)


def _scanned(products: DataFrame, kept: list[str], vocab: Vocabulary) -> DataFrame:
    """A row per product and free text that may hold something, with the masked hits of each kind."""
    fields = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), F.col(f).alias("text")) for i, f in enumerate(SCANNED_FIELDS)])
    texts = products.select(*kept, F.explode(fields).alias("f")).select(*kept, "f.*").withColumn("flat", squash(F.col("text")))
    text, flat = F.col("text"), F.col("flat")
    maybe = F.contains(text, F.lit("@")) | privacy.may_hold_numbers(text) | privacy.any_term_in(flat, vocab.prohibited_terms)
    # the spans of numbers are found once for all kinds that need them
    phones, taken = F.concat("_mobile", "_landline"), F.concat("_mobile", "_landline", "_resident")
    found = {"_mobile": privacy.MOBILE, "_landline": privacy.LANDLINE, "_resident": privacy.RESIDENT}
    kinds = (
        privacy.terms_in(flat, vocab.prohibited_terms), privacy.find_emails(text), privacy.find_phones(text, phones),
        privacy.find_residents(text), privacy.find_accounts(text, vocab, flat, taken),
    )
    shown = {rule: F.transform(values, _applied(mask)) for (rule, _, _, mask), values in zip(_SCANS, kinds, strict=True)}
    return texts.where(maybe).withColumns({name: privacy.spans(text, pattern) for name, pattern in found.items()}).withColumns(shown)


def _applied(mask):
    return lambda value: mask(value)


def text_scan(products: DataFrame, kept: list[str], vocab: Vocabulary) -> DataFrame:
    """Prohibited terms and personal data in the free-text fields, per field and in a fixed order: ``kept``, sub_ord, hit.

    The fields are rows, so the patterns are planned once; texts without enough digits, an @ or a term go at once.
    """
    def reported(rule: str, severity: str, what: str) -> Column:
        opening = F.concat(F.lit("field '"), F.col("field"), F.lit(f"' contains {what} '"))
        return F.transform(
            F.col(rule), lambda shown: finding(rule, severity, F.concat(opening, shown, F.lit("'")), field=F.col("field"), value=shown)
        )

    found = F.concat(*[reported(rule, severity, what) for rule, severity, what, _ in _SCANS])
    hits = _scanned(products, kept, vocab).select(*kept, "place", F.posexplode(found).alias("at", "hit"))
    return hits.select(*kept, (F.col("place") * _HITS_PER_FIELD + F.col("at")).alias("sub_ord"), "hit")


ROW_RULES = (
    RowRule("missing_required_field", 6, missing_fields),
    RowRule("non_standard_color", 7, non_standard_color, (_standard_values,)),
    RowRule("non_standard_size", 8, non_standard_size, (_standard_values,)),
    RowRule("invalid_category", 9, invalid_category),
    RowRule("stock", 10, stock),
    RowRule("price", 11, price),
    RowRule("sale_price", 12, sale_price),
    RowRule("product_category_mismatch", 14, category_mismatch, (_joined_name, _implied_categories)),
    RowRule("text_scan", 15, rows=text_scan),
)


def _placed(position: int):
    return lambda hit: F.struct(
        hit["rule"].alias("rule"), hit["severity"].alias("severity"), hit["args"].alias("args"),
        hit["message"].alias("message"), F.lit(position).alias("rule_ord"),
    )


def run_row_rules(products: DataFrame, rules: tuple[RowRule, ...], vocab: Vocabulary) -> DataFrame:
    """Issues of all given row rules: one scan of the products for all findings, and one for each rule with rows of its own."""
    kept = [*[name for name in ("catalog_id",) if name in products.columns], "product_id", "product_group_id", "row_index"]
    together = [rule for rule in rules if rule.findings]
    parts = []
    if together:
        rows = products
        for depth in range(max(len(rule.steps) for rule in together)):
            layer: dict[str, Column] = {}
            for rule in together:
                if depth < len(rule.steps):
                    layer.update(rule.steps[depth](vocab))
            rows = rows.withColumns(layer)
        found = F.concat(*[F.transform(rule.findings(vocab), _placed(rule.position)) for rule in together])
        parts.append(rows.select(*kept, F.posexplode(found).alias("sub_ord", "hit")))
    for rule in rules:
        if rule.rows:
            alone = rule.rows(products, kept, vocab)
            parts.append(alone.withColumn("hit", _placed(rule.position)(F.col("hit"))))
    hit = F.col("hit")
    return reduce(DataFrame.unionByName, parts).select(
        *kept[:-3], hit["rule"].alias("rule"), hit["severity"].alias("severity"), "product_id", "product_group_id",
        hit["args"].alias("args"), hit["message"].alias("message"), hit["rule_ord"].alias("rule_ord"),
        F.col("row_index").alias("lead_row"), "row_index", "sub_ord",
    )
