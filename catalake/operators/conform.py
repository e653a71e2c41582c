"""Supplier rows -> standard rows, with every reason a row is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalake.functions.keys import field_required
from catalake.functions.profiles import Profile
from catalake.functions.text import strip, whole_number
from catalake.functions.vocabulary import DEFAULT, REQUIRED_TEXT_FIELDS, STANDARD_COLUMNS, Vocabulary

# Codes and texts stored with refused rows.
MISSING_SOURCE = "MISSING_SOURCE_VALUE"
MESSAGES = {
    "INVALID_PRICE": "가격 값을 숫자로 변환할 수 없습니다.",
    "INVALID_STOCK": "재고 값을 정수로 변환할 수 없습니다.",
    "MISSING_PRODUCT_ID": "상품 ID가 비어 있습니다.",
    "MISSING_SOURCE_VALUE": "필수 공급사 값이 비어 있습니다",
    "NEGATIVE_PRICE": "가격은 음수일 수 없습니다.",
    "NEGATIVE_STOCK": "재고는 음수일 수 없습니다.",
}

ERRORS = "array<struct<code:string,field:string,message:string>>"


def _error(code: str | Column, field: str, message: str | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_column(code).alias("code"), F.lit(field).alias("field"), as_column(message).alias("message")
    )


def map_columns(rows: DataFrame, profile: Profile, keep: list[str]) -> DataFrame:
    """Standard columns (text) by the profile's mapping and defaults, beside the trimmed source columns."""
    trimmed = rows.select(
        *keep,
        *[(strip(F.col(name)) if name in rows.columns else F.lit("")).alias(f"_src_{name}") for name in profile.sources],
    )
    values = {name: F.lit(profile.defaults.get(name, "")) for name in STANDARD_COLUMNS}
    for source, targets in profile.targets.items():
        value = F.col(f"_src_{source}")
        for target in targets:
            default = profile.defaults.get(target)
            values[target] = value if default is None else F.when(value != "", value).otherwise(F.lit(default.strip()))
    return trimmed.withColumns(values)


def _number_check(value: Column, number: Column, field: str, kind: str) -> Column:
    """The error of a number text, or NULL."""
    return F.when(
        number.isNull(), _error(f"INVALID_{kind}", field, MESSAGES[f"INVALID_{kind}"])
    ).when(number < 0, _error(f"NEGATIVE_{kind}", field, MESSAGES[f"NEGATIVE_{kind}"]))


def price_number(text: Column) -> Column:
    return whole_number(strip(F.translate(text, "₩,", "")))


def conform(rows: DataFrame, profile: Profile, keep: list[str], vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Standard columns, ``errors`` (all of them, in checking order) and ``source`` (trimmed source values).

    One narrow pass; split it with ``accepted`` and ``rejected``.
    """
    mapped = map_columns(rows, profile, keep)
    category = F.col("category")
    numbered = mapped.withColumns(
        {
            "_price": price_number(F.col("price")),
            "_sale": price_number(F.col("sale_price")),
            "_stock": whole_number(F.col("stock")),
        }
    )
    checks: list[Column] = []
    for source in profile.required:
        targets = profile.targets.get(source, ())
        needed = F.lit(not targets)
        for target in targets:
            needed |= field_required(category, target, vocab)
        blank = F.col(f"_src_{source}") == ""
        checks.append(
            F.when(blank & needed, _error(MISSING_SOURCE, source, f"{MESSAGES[MISSING_SOURCE]}: {source}"))
        )
    checks += [
        F.when(
            F.col("product_id") == "", _error("MISSING_PRODUCT_ID", "product_id", MESSAGES["MISSING_PRODUCT_ID"])
        ),
        _number_check(F.col("price"), F.col("_price"), "price", "PRICE"),
        F.when(F.col("sale_price") != "", _number_check(F.col("sale_price"), F.col("_sale"), "sale_price", "PRICE")),
        _number_check(F.col("stock"), F.col("_stock"), "stock", "STOCK"),
    ]
    source_pairs = [part for name in profile.sources for part in (F.lit(name), F.col(f"_src_{name}"))]
    normal = {
        "price": F.coalesce(F.col("_price").cast("string"), F.col("price")),
        "sale_price": F.coalesce(F.col("_sale").cast("string"), F.col("sale_price")),
        "stock": F.coalesce(F.col("_stock").cast("string"), F.col("stock")),
    }
    return numbered.select(
        *keep,
        *[normal.get(name, F.col(name)).alias(name) for name in STANDARD_COLUMNS],
        F.array_compact(F.array(*checks)).alias("errors"),
        F.create_map(*source_pairs).alias("source"),
    )


def accepted(conformed: DataFrame) -> DataFrame:
    return conformed.where(F.size("errors") == 0).drop("errors", "source")


def rejected(conformed: DataFrame, keep: list[str]) -> DataFrame:
    """Refused rows: their place, parallel code / field / message arrays and the source values."""
    return conformed.where(F.size("errors") > 0).select(
        *keep,
        F.col("errors.code").alias("error_code"), F.col("errors.field").alias("error_field"),
        F.col("errors.message").alias("error_message"), "errors", "source",
    )


def batch_summary(conformed: DataFrame, batch: list[str]) -> DataFrame:
    """Counts per batch; ``error_counts`` maps code to count, in code order. One partial aggregation."""
    def occurrences(code: str) -> Column:
        return F.sum(F.size(F.filter("errors", lambda e: e["code"] == code))).cast("bigint")

    bad = F.size("errors") > 0
    pairs = [part for code in sorted(MESSAGES) for part in (F.lit(code), F.col(f"_n_{code}"))]
    return (
        conformed.groupBy(*batch)
        .agg(
            F.count(F.lit(1)).alias("total_rows"), F.count_if(~bad).alias("loaded_rows"),
            F.count_if(bad).alias("rejected_rows"), *[occurrences(code).alias(f"_n_{code}") for code in MESSAGES],
        )
        .select(
            *batch, "total_rows", "loaded_rows", "rejected_rows",
            F.map_filter(F.create_map(*pairs), lambda _, n: n > 0).alias("error_counts"),
        )
    )


# --- audits of stored batches ---


def summary_violations(runs: DataFrame) -> DataFrame:
    """One row per broken promise of a batch summary: (id, violation)."""
    c = F.col
    counts = F.map_values("error_counts")
    total_errors = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n)
    known = c("error_counts").isNotNull()
    negative = F.least("total_rows", "loaded_rows", "rejected_rows") < 0
    checks = {
        "negative_count": negative,
        "total_mismatch": c("total_rows") != c("loaded_rows") + c("rejected_rows"),
        "blank_error_code": known & F.exists(F.map_keys("error_counts"), lambda k: strip(k) == ""),
        "non_positive_error_count": known & F.exists(counts, lambda n: n < 1),
        "errors_without_rejects": known & (c("rejected_rows") == 0) & (F.size("error_counts") > 0),
        "too_few_errors": known & (c("rejected_rows") > 0) & (total_errors < c("rejected_rows")),
        "bad_input_hash": ~F.lower(strip(c("input_file_sha256"))).rlike(r"\A[0-9a-f]{64}\z"),
        "bad_output_hash": ~F.lower(strip(c("output_file_sha256"))).rlike(r"\A[0-9a-f]{64}\z"),
        "bad_profile_name": ~F.length(strip(c("profile_name"))).between(1, 100),
        "bad_profile_version": ~F.length(strip(c("profile_version"))).between(1, 20),
        "blank_file_name": strip(c("source_filename")) == "",
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))
    return runs.select("id", F.explode(broken).alias("violation"))


def staging_rows(standard: DataFrame, batch: list[str], vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Typed staging rows with ``problem`` (NULL when fine). Blank description, seller and sale price become NULL."""
    def number(name: str) -> Column:
        return whole_number(F.replace(strip(F.col(name)), F.lit(","), F.lit("")))

    cleaned = standard.withColumns({name: strip(F.col(name)) for name in STANDARD_COLUMNS})
    typed = cleaned.withColumns({f"_{name}": number(name) for name in ("stock", "price", "sale_price")})
    missing = F.lit(False)
    for name in REQUIRED_TEXT_FIELDS:
        missing |= (F.col(name) == "") & field_required(F.col("category"), name, vocab)
    problem = F.when(missing, F.lit("missing_field"))
    for name in ("stock", "price", "sale_price"):
        given = F.col(name) != "" if name == "sale_price" else F.lit(True)
        problem = problem.when(given & F.col(f"_{name}").isNull(), F.lit(f"invalid_{name}"))
        problem = problem.when(given & (F.col(f"_{name}") < 0), F.lit(f"negative_{name}"))
    shown = {name: F.col(f"_{name}") for name in ("stock", "price", "sale_price")}
    shown |= {name: F.nullif(F.col(name), F.lit("")) for name in ("description", "seller")}
    extra = [name for name in standard.columns if name not in STANDARD_COLUMNS and name not in batch]
    return typed.select(
        *batch, *extra, *[shown.get(name, F.col(name)).alias(name) for name in STANDARD_COLUMNS], problem.alias("problem")
    )


def staging_admission(standard: DataFrame, batch: list[str], vocab: Vocabulary = DEFAULT) -> DataFrame:
    """One verdict per batch: a single bad row refuses the whole batch."""
    rows = staging_rows(standard, batch, vocab)
    return rows.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("row_count"), F.count("problem").alias("bad_rows"),
    ).withColumn("admitted", F.col("bad_rows") == 0)


def reject_violations(rejects: DataFrame, batch: list[str]) -> DataFrame:
    """Broken refused rows: (batch, source_row_number, violation). Expects parallel code/field/message arrays."""
    code, field, message = (F.col(f"error_{part}") for part in ("code", "field", "message"))

    def any_item(values: Column, test) -> Column:
        return F.exists(values, lambda x: test(x))

    blank = lambda x: x.isNull() | (strip(x) == "")
    checks = {
        "row_number_too_small": F.col("source_row_number") < 2,
        "no_errors": (F.size(code) == 0) | (F.size(field) == 0) | (F.size(message) == 0),
        "length_mismatch": (F.size(code) != F.size(field)) | (F.size(code) != F.size(message)),
        "blank_item": any_item(code, blank) | any_item(field, blank) | any_item(message, blank),
        "bad_code": any_item(code, lambda x: ~strip(x).rlike(r"\A[A-Z][A-Z0-9_]*\z")),
        "too_long": any_item(code, lambda x: F.length(x) > 100) | any_item(field, lambda x: F.length(x) > 100)
        | any_item(message, lambda x: F.length(x) > 2000),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))
    per_row = rejects.select(*batch, "source_row_number", F.explode(broken).alias("violation"))
    repeated = rejects.groupBy(*batch, "source_row_number").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return per_row.unionByName(
        repeated.select(*batch, "source_row_number", F.lit("repeated_row_number").alias("violation"))
    )


def reject_count_violations(rejects: DataFrame, summary: DataFrame, batch: list[str]) -> DataFrame:
    """Batches whose number of refused rows differs from their summary."""
    stored = rejects.groupBy(*batch).agg(F.count(F.lit(1)).alias("stored"))
    joined = summary.select(*batch, "rejected_rows").join(stored, batch, "left")
    return joined.select(*batch, "rejected_rows", F.coalesce("stored", F.lit(0)).alias("stored")).where(
        F.col("rejected_rows") != F.col("stored")
    )
