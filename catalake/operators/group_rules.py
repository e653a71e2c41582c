"""Inspection rules that compare products with each other.

All of them but the price rule go one way, whatever the size of a group. One projection gives each product its cells: for
every rule it takes part in, the key, and for two rules also the parts of the key by which rows are told apart (id, content,
color, size). A cell is named by 128 bits of hash, so neither keys nor parts travel. One partial aggregate counts all cells
of all rules; cells of one row say nothing and are dropped; one salted join brings the others back to their rows, and one
aggregate per row and rule decides. No rule forms pairs of rows and no list of members is gathered: an issue names its key,
the number of rows and the first row, and ``group_members`` has the members as a table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalake.functions import keys
from catalake.functions.vocabulary import DEFAULT, Vocabulary
from catalake.operators.row_rules import say
from catalake.operators.skew import salted_join, spread

# Products of many catalogs can be inspected at once: rows with this column are compared only within its value.
SCOPE = "catalog_id"
# Rows are shown with their position in the file: the header is 1, the first product 2.
FIRST_ROW_NUMBER = 2

SAME_ID, MIXED_CATEGORIES, MIXED_SIZES, SAME_VARIANT, SAME_NAME, SAME_CONTENT, PRICE = (
    "duplicate_product_id", "inconsistent_group_category", "inconsistent_group_size_system",
    "duplicate_variant_combination", "duplicate_product_name", "duplicate_product_content", "category_price_anomaly",
)


@dataclass(frozen=True)
class GroupRule:
    name: str
    position: int
    severity: str


GROUP_RULES = (
    GroupRule(SAME_ID, 0, "error"),
    GroupRule(MIXED_CATEGORIES, 1, "error"),
    GroupRule(MIXED_SIZES, 2, "warning"),
    GroupRule(SAME_VARIANT, 3, "error"),
    GroupRule(SAME_NAME, 4, "warning"),
    GroupRule(SAME_CONTENT, 5, "error"),
    GroupRule(PRICE, 13, "warning"),
)
COMPARED = tuple(rule.name for rule in GROUP_RULES if rule.name != PRICE)


def _scope(frame: DataFrame) -> list[str]:
    return [SCOPE] if SCOPE in frame.columns else []


def _row_number(row_index: Column) -> Column:
    return row_index + FIRST_ROW_NUMBER


# What a cell counts: all rows of a key, or those of a key and an id, a content, ...
_ALL, _ID, _CONTENT, _BOTH, _OPTION, _COLOR, _SIZE = range(7)
_CODES = {rule.name: rule.position for rule in GROUP_RULES}
# No color or no size (where the rule asks); a part of a color without size, or of a size without color.
_FLAGS = ("no_color", "no_size", "bare")


def _cells(products: DataFrame, vocab: Vocabulary, names: Iterable[str]) -> DataFrame:
    """The cells of every product: code of the rule, kind, hashes, flags, and ``who``.

    ``who`` is the row's key and what an issue shows of it, with the value ``a`` that must not vary in the key; only cells
    of whole keys have it.
    """
    c = F.col
    none = F.lit(None).cast("string")
    filled = lambda *fields: [c(field) != "" for field in fields]

    def cell(rule: str, kind: int, values: list[Column], who: Column, *flags: Column) -> Column:
        named = [F.lit(_CODES[rule]), F.lit(kind), *values]
        return F.struct(
            F.lit(_CODES[rule]).alias("code"), F.lit(kind).alias("kind"), F.xxhash64(*named).alias("h1"),
            F.xxhash64(F.lit("2"), *named).alias("h2"), *[flag.alias(n) for n, flag in zip(_FLAGS, flags, strict=True)], who.alias("who"),
        )

    def of_rule(rule: str, key: list[Column], *when: Column, a: Column = none, i: Column = none, p: Column = none,
                s: Column = none, parts: Iterable[tuple] = ()) -> Column:
        test = F.lit(True)
        for condition in when:
            test = test & condition
        who = F.struct(
            F.array(*key).alias("key"), a.alias("a"), i.alias("i"), c("product_id"), c("product_group_id"), c("product_name"),
        )
        lacks = [F.coalesce(p == "", F.lit(False)), F.coalesce(s == "", F.lit(False))]
        made = [cell(rule, _ALL, key, who, *lacks, F.lit(False))]
        for kind, values, bare, known in parts:
            made.append(F.when(known, cell(rule, kind, [*key, *values], F.lit(None), *lacks, bare)))
        return F.when(test, F.array(*made)).otherwise(F.array())

    # every key is derived once, below the projection that puts the cells together
    derived = products.withColumns({
        "_content": keys.content_key(vocab), "_name": keys.name_key(c("product_name")), "_category": keys.category_key(c("category"), vocab),
        "_color": keys.color_key(c("color"), vocab), "_size": keys.variant_size_key(c("category"), c("size"), vocab),
        "_system": keys.size_system(c("size"), vocab), "_id": keys.option_key(c("product_id")), "_group": keys.option_key(c("product_group_id")),
        "_c": keys.option_key(c("color")), "_s": keys.option_key(c("size")),
    })
    has_size = (c("size") != "") | c("category").isin(*vocab.size_optional)
    always, never, known = F.lit(True), F.lit(False), c("_content").isNotNull()
    made = {
        SAME_ID: lambda: of_rule(SAME_ID, [c("product_id")], *filled("product_id")),
        MIXED_CATEGORIES: lambda: of_rule(
            MIXED_CATEGORIES, [c("product_group_id")], *filled("product_group_id", "category"), a=c("_category"),
        ),
        MIXED_SIZES: lambda: of_rule(
            MIXED_SIZES, [c("product_group_id")], *filled("product_group_id", "size"), c("_system").isNotNull(), a=c("_system")
        ),
        SAME_VARIANT: lambda: of_rule(
            SAME_VARIANT, [c("product_group_id"), c("_color"), c("_size")],
            *filled("product_group_id", "product_id", "color"), has_size, a=c("product_id"),
            parts=[(_ID, [c("product_id")], never, always), (_CONTENT, [c("_content")], never, known),
                   (_BOTH, [c("product_id"), c("_content")], never, known)],
        ),
        SAME_NAME: lambda: of_rule(
            SAME_NAME, [c("_name")], c("_name") != "", a=c("_group"), i=c("_id"), p=c("_c"), s=c("_s"),
            parts=[(_ID, [c("_id")], never, always), (_OPTION, [c("_c"), c("_s")], never, always),
                   (_COLOR, [c("_c")], c("_s") == "", always), (_SIZE, [c("_s")], c("_c") == "", always)],
        ),
        SAME_CONTENT: lambda: of_rule(SAME_CONTENT, [c("_content")], known),
    }
    listed = F.array_compact(F.concat(*[made[name]() for name in names]))
    return derived.select(*_scope(products), "row_index", F.explode(listed).alias("cell")).select(*_scope(products), "row_index", "cell.*")


def _counted(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells of more than one row, with their totals: numbers only, so that they are hashed and never sorted."""
    no_color, no_size, value = F.col("no_color"), F.col("no_size"), F.xxhash64("who.a")
    return cells.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bare").alias("n_bare_part"), F.min("row_index").alias("first_row"),
        (F.min(value) != F.max(value)).alias("varies"),
        F.count_if((F.col("who.a") == "") | (F.col("who.i") == "")).alias("n_blank"),
        F.count_if(no_color).alias("n_no_color"), F.count_if(no_size).alias("n_no_size"),
        F.count_if(no_color & no_size).alias("n_bare"),
    ).where("n > 1")


def _texts(products: DataFrame, vocab: Vocabulary, names: set[str], key: list[str]) -> DataFrame:
    """What an issue says of other rows of its key: smallest and largest category, id and group of the first row."""
    return _cells(products, vocab, sorted(names)).groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"), F.min("who.a").alias("low"), F.max("who.a").alias("high"),
        F.min(F.struct("row_index", "who.product_id", "who.product_group_id")).alias("first"),
    ).where("rows > 1").drop("rows")


def _weight() -> Column:
    """What a counted cell says of its row: other rows it covers (variants) or a partner found (names)."""
    kind, n = F.col("kind"), F.col("n")
    # rows of the same id, and rows of the same content, less those of both; cells of one row were dropped
    covered = F.when(kind.isin(_ID, _CONTENT), n - 1).when(kind == _BOTH, 1 - n)
    # A full row meets its twins, rows of its color without size and rows of its size without color. A row without
    # size meets every row of its color (and every row without color); likewise the other way round.
    no_color, no_size = F.col("no_color"), F.col("no_size")
    meets = (
        F.when(kind == _ID, True)
        .when(kind == _OPTION, ~no_color & ~no_size)
        .when(kind == _COLOR, F.when(no_size, True).otherwise(~no_color & (F.col("n_bare_part") > 0)))
        .when(kind == _SIZE, F.when(no_color, True).otherwise(~no_size & (F.col("n_bare_part") > 0)))
    )
    return F.when(F.col("code") == _CODES[SAME_VARIANT], covered).otherwise(meets.cast("bigint"))


def _breaks() -> Column:
    """Whether a row (with the totals of its key and its weight) breaks its rule."""
    code, weight = F.col("code"), F.coalesce("weight", F.lit(0))
    varies = F.col("varies")
    # In a bucket of equal names that spans several groups, or has a blank group or id, or a row without color and
    # size, every row has a partner that is not merely another option of the same product.
    every = varies | (F.col("n_blank") > 0) | (F.col("n_bare") > 0)
    blank = (F.col("no_size") & (F.col("n_no_color") > 0)) | (F.col("no_color") & (F.col("n_no_size") > 0))
    return (
        F.when(code == _CODES[SAME_ID], True).when(code == _CODES[SAME_CONTENT], F.col("row_index") > F.col("first_row"))
        .when(code == _CODES[SAME_NAME], every | (weight > 0) | blank)
        .when(code == _CODES[SAME_VARIANT], varies & (F.col("n") > 1 + weight))
        .otherwise(varies)
    )


def flagged(products: DataFrame, vocab: Vocabulary = DEFAULT, names: Iterable[str] = COMPARED) -> DataFrame:
    """Rows that break a comparing rule: rule, key, the key's totals, and the row."""
    names = [name for name in COMPARED if name in set(names)]
    scope = _scope(products)
    cells = _cells(products, vocab, names)
    key = [*scope, "h1", "h2"]
    rows = salted_join(cells, _counted(cells, key), key)
    totals = ("n", "first_row", "varies", "n_blank", "n_no_color", "n_no_size", "n_bare", "h1", "h2")
    shown = [F.col(f"who.{c}") for c in ("key", "a", "product_id", "product_group_id", "product_name")]
    whole = F.when(F.col("kind") == _ALL, F.struct("no_color", "no_size", *shown, *totals))
    if not {SAME_VARIANT, SAME_NAME} & set(names):
        decided = rows.withColumn("row", whole).select(*scope, "code", "row_index", F.lit(0).alias("weight"), "row.*")
    else:
        # the texts of a row are sorted to be grouped: once, and in as many parts as shuffles have
        decided = spread(rows, *scope, "code", "row_index").groupBy(*scope, "code", "row_index").agg(
            F.any_value(whole, F.lit(True)).alias("row"), F.sum(_weight()).alias("weight")
        ).where("row is not null").select(*scope, "code", "row_index", "weight", "row.*")
    named = F.create_map(*[F.lit(x) for name, code in _CODES.items() for x in (code, name)])
    broken = decided.where(_breaks()).withColumn("rule", F.element_at(named, F.col("code")))
    told = {MIXED_CATEGORIES, SAME_CONTENT} & set(names)
    if not told:
        none = F.lit(None).cast("string")
        return broken.withColumns({"low": none, "high": none, "first": F.struct(none.alias("product_id"), none.alias("product_group_id"))})
    return salted_join(broken, _texts(products, vocab, told, key), key, how="left")


def group_issues(products: DataFrame, vocab: Vocabulary = DEFAULT, names: Iterable[str] = COMPARED) -> DataFrame:
    """Issues of the comparing rules."""
    rule, key, n = F.col("rule"), F.col("key"), F.col("n")
    first_row = _row_number(F.col("first_row"))
    group, color, size = F.get(key, F.lit(0)), F.get(key, F.lit(1)), F.get(key, F.lit(2))
    value = F.when(rule == SAME_NAME, F.col("product_name")).otherwise(group)
    mixed = F.to_json(F.struct(
        group.alias("product_group_id"), F.array("low", "high").alias("categories"), n.alias("count"), first_row.alias("first_row")
    ))
    variant = F.to_json(F.struct(
        group.alias("product_group_id"), color.alias("color"), size.alias("size"), n.alias("count"), first_row.alias("first_row")
    ))
    message = (
        F.when(rule == SAME_ID, say("product_id '{}' is used in {} rows, first in row {}", group, n, first_row))
        .when(rule == MIXED_CATEGORIES, F.concat(F.lit(f"{MIXED_CATEGORIES}:"), mixed))
        .when(rule == MIXED_SIZES, F.lit("product group mixes alpha and numeric size systems"))
        .when(rule == SAME_VARIANT, F.concat(F.lit(f"{SAME_VARIANT}:"), variant))
        .when(rule == SAME_NAME, say(
            "product_name '{}' normalized to '{}' is used in {} rows, first in row {}", value, group, n, first_row
        ))
        .otherwise(say(
            "product_id '{}' in group '{}' duplicates product_id '{}' in group '{}' "
            "with same product_name, category, color, size, and price",
            F.col("product_id"), F.col("product_group_id"), F.col("first.product_id"), F.col("first.product_group_id"),
        ))
    )
    totals = {"count": n, "first_row": first_row}
    arguments = (
        F.when(rule == SAME_ID, _arguments({"value": value, **totals}))
        .when(rule == SAME_NAME, _arguments({"value": value, "name_key": group, **totals}))
        .when(rule == MIXED_CATEGORIES, _arguments({
            "group": group, "categories": say("'{}', '{}'", F.col("low"), F.col("high")), **totals
        }))
        .when(rule == SAME_VARIANT, _arguments({"group": group, "color": color, "size": size, **totals}))
        .when(rule == SAME_CONTENT, _arguments({
            "id": F.col("product_id"), "group": F.col("product_group_id"), "first_id": F.col("first.product_id"),
            "first_group": F.col("first.product_group_id"),
        }))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    of_rule = lambda what: F.element_at(
        F.create_map(*[F.lit(x) for r in GROUP_RULES for x in (r.name, getattr(r, what))]), rule
    )
    lead = F.when(rule.isin(SAME_ID, SAME_NAME), F.col("first_row")).otherwise(F.col("row_index"))
    return flagged(products, vocab, names).select(
        *_scope(products), "rule", of_rule("severity").alias("severity"), "product_id", "product_group_id",
        arguments.alias("args"), message.alias("message"), of_rule("position").alias("rule_ord"), lead.alias("lead_row"),
        "row_index", F.lit(0).alias("sub_ord"),
    )


def _arguments(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value.cast("string"))])


def group_members(products: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Whole membership of every flagged group: (rule, group, row_number, product_id)."""
    members = flagged(products, vocab, (SAME_ID, MIXED_CATEGORIES, SAME_VARIANT, SAME_NAME))
    return members.select(
        *_scope(products), "rule", F.array_join("key", keys.PART_SEPARATOR).alias("group"),
        _row_number(F.col("row_index")).alias("row_number"), "product_id",
    )


def group_categories(products: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Every category of every mixed group: (product_group_id, category_key, shown, n, first_row).

    ``shown`` is the category as written in the first of its ``n`` rows.
    """
    rows = products.where((F.col("product_group_id") != "") & (F.col("category") != ""))
    group = [*_scope(products), "product_group_id"]
    parts = rows.groupBy(*group, keys.category_key(F.col("category"), vocab).alias("category_key")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row_index", F.col("category").alias("shown"))).alias("first")
    )
    mixed = parts.groupBy(*group).agg(F.count(F.lit(1)).alias("n_keys")).where("n_keys > 1").drop("n_keys")
    return salted_join(parts, mixed, group, "category_key").select(
        *group, "category_key", F.col("first.shown").alias("shown"), "n", _row_number(F.col("first.row_index")).alias("first_row")
    )


def group_category_members(products: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """The rows of every category of every mixed group: (product_group_id, category_key, row_number, product_id)."""
    return flagged(products, vocab, (MIXED_CATEGORIES,)).select(
        *_scope(products), "product_group_id", F.col("a").alias("category_key"),
        _row_number(F.col("row_index")).alias("row_number"), "product_id",
    )


# --- price against the median of its category ---

MIN_PRICES = 5
LOW_RATIO = 0.25
HIGH_RATIO = 4.0


def _priced_rows(products: DataFrame, vocab: Vocabulary) -> DataFrame:
    # a filter would move below the shuffle that the steps of an inspection share, and products be read once more for it
    priced = F.when((F.col("category") != "") & (F.col("price") > 0), F.array(F.struct(
        "row_index", "product_id", "product_group_id", "price",
        keys.category_key(F.col("category"), vocab).alias("category_key"), F.col("category").alias("shown"),
    )))
    return products.select(*_scope(products), F.inline(priced))


def exact_medians(rows: DataFrame, key: list[str], value: str, at_least: int = 1) -> DataFrame:
    """Exact median of BIGINTs per key: (key, n, median).

    Equal values are counted first. The middle values are then found from the top by pieces of the value: 21 bits at a
    time, so no task orders more than 2**21 entries of one key, whatever the number of rows or distinct values.
    """
    bits, mask = 21, (1 << 21) - 1
    counts = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    found = None
    for level in (2, 1, 0):
        shift = level * bits
        digit = F.shiftright(value, shift).bitwiseAND(mask)
        if found is None:
            by_digit = counts.groupBy(*key, digit.alias("digit")).agg(F.sum("n").alias("n"))
            within = Window.partitionBy(*key)
            running = by_digit.withColumns({
                "total": F.sum("n").over(within),
                "upto": F.sum("n").over(within.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)),
            }).where(F.col("total") >= at_least)
            ranks = F.explode(F.array_distinct(F.array(F.expr("(total - 1) div 2"), F.expr("total div 2"))))
            ranked = running.withColumn("rank", ranks).withColumn("prefix", F.lit(0).cast("bigint"))
        else:
            above = F.shiftright(value, shift + bits)
            by_digit = counts.withColumn("prefix", above).join(found.hint("merge"), [*key, "prefix"]).groupBy(
                *key, "prefix", "rank", "total", digit.alias("digit")
            ).agg(F.sum("n").alias("n"))
            within = Window.partitionBy(*key, "prefix", "rank").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
            ranked = by_digit.withColumn("upto", F.sum("n").over(within))
        inside = (F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("upto"))
        found = ranked.where(inside).select(
            *key, "total", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"),
            F.shiftleft("prefix", bits).bitwiseOR(F.col("digit")).alias("prefix"),
        )
    return found.groupBy(*key).agg(
        F.first("total").alias("n"),
        ((F.min("prefix").cast("double") + F.max("prefix").cast("double")) / 2).alias("median"),
    )


def category_medians(products: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(category_key, n, median) for categories with enough valid prices."""
    rows = _priced_rows(products, vocab)
    return exact_medians(rows, [*_scope(rows), "category_key"], "price", MIN_PRICES)


def plain_number(value: Column) -> Column:
    """Whole values without a fraction, others with two decimals."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(
        F.format_string("%.2f", F.bround(value, 2))
    )


def price_outliers(products: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Issues of the price rule."""
    rows = _priced_rows(products, vocab)
    key = [*_scope(rows), "category_key"]
    medians = category_medians(products, vocab).select(*key, "median")
    price, median = F.col("price"), F.col("median")
    far = salted_join(rows, medians, key).where(
        (price < median * LOW_RATIO) | (price > median * HIGH_RATIO)
    )
    ratio = price / median
    message = say(
        "price {} in category '{}' has median {} and ratio {}",
        price, F.col("shown"), plain_number(median), plain_number(ratio),
    )
    arguments = {"price": price, "category": F.col("shown"), "median": plain_number(median), "ratio": plain_number(ratio)}
    return far.select(
        *_scope(products), F.lit(PRICE).alias("rule"), F.lit("warning").alias("severity"), "product_id", "product_group_id",
        _arguments(arguments).alias("args"), message.alias("message"), F.lit(13).alias("rule_ord"),
        F.col("row_index").alias("lead_row"), "row_index", F.lit(0).alias("sub_ord"),
    )
