"""Issue report: labels, display texts, counts, filters and spreadsheet-safe export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from catalake.functions.text import strip
from catalake.functions.vocabulary import (
    DEFAULT_RECOMMENDATION,
    FIELD_LABELS,
    RISK_ORDER,
    RULE_CARDS,
    SEVERITY_LABELS,
    lookup_in,
)
from catalake.operators.inspect import DISCOVERY_ORDER
from catalake.operators.row_rules import say
from catalake.operators.skew import spread

# Texts shown for missing values.
UNCLASSIFIED_RULE = "분류 없음"
NO_PRODUCT_ID = "상품 ID 없음"
NO_PRODUCT_ID_AS_INPUT = "상품 ID 없음 (입력값)"
NO_SIZE = "없음"
STATUS_ERROR, STATUS_WARNING, STATUS_NORMAL = "오류", "주의", "정상"
FORMULA_START = r"\A[=+\-@]"


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(99)


def _arg(name: str) -> Column:
    return F.try_element_at(F.col("args"), F.lit(name))


def with_commas(number_text: Column) -> Column:
    return F.format_number(number_text.cast("bigint"), 0)


def short_number(value: Column) -> Column:
    """At most six significant digits, no trailing zeros, exponent from a million on."""
    digits = F.greatest(F.floor(F.log10(F.greatest(value, F.lit(1e-4)))).cast("int") + 1, F.lit(1))
    fixed = F.format_string("%.5f", value)
    for places in range(6):
        fixed = F.when(digits == 6 - places, F.format_string(f"%.{places}f", value)).otherwise(fixed)
    trimmed = F.when(F.contains(fixed, F.lit(".")), F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))).otherwise(fixed)
    scientific = F.format_string("%.5e", value)
    mantissa = F.rtrim(F.rtrim(F.substring_index(scientific, "e", 1), F.lit("0")), F.lit("."))
    return F.when(value >= 999999.5, F.concat(mantissa, F.lit("e"), F.substring_index(scientific, "e", -1))).otherwise(
        trimmed
    )


def reason_text() -> Column:
    """Sentence for the reader, written from the rule and its arguments."""
    field = F.coalesce(lookup_in(FIELD_LABELS, _arg("field")), _arg("field"))
    value, count, first_row = _arg("value"), _arg("count"), _arg("first_row")
    median = F.format_number(F.bround(_arg("median").cast("double"), 0), 0)
    shown_size = F.when(_arg("size") == "", F.lit(NO_SIZE)).otherwise(say("'{}'", _arg("size")))
    sentences = {
        "prohibited_term": say("{}에 금지어 '{}'이 포함되어 있습니다.", field, value),
        "email_address": say("{}에 이메일 주소 '{}'이 포함되어 있습니다.", field, value),
        "phone_number": say("{}에 전화번호 '{}'이 포함되어 있습니다.", field, value),
        "resident_registration_number": say("{}에 주민등록번호 형식 '{}'이 포함되어 있습니다.", field, value),
        "suspected_bank_account": say("{}에 계좌번호로 의심되는 값 '{}'이 포함되어 있습니다.", field, value),
        "duplicate_product_id": say(
            "동일한 상품 ID '{}'가 여러 상품에 사용되었습니다. 중복 행: {}개, 첫 행: {}.", value, count, first_row
        ),
        "duplicate_product_name": say(
            "상품명 '{}'이 다른 상품과 동일하거나 정리 후 같은 값으로 확인되었습니다. 같은 이름의 행: {}개, 첫 행: {}.",
            value, count, first_row,
        ),
        "inconsistent_group_category": say(
            "상품 그룹 '{}'에 서로 다른 카테고리 {}가 함께 등록되어 있습니다.", _arg("group"), _arg("categories")
        ),
        "inconsistent_group_size_system": say(
            "상품 그룹 '{}'에서 문자형 사이즈와 숫자형 사이즈가 함께 사용되고 있습니다.", F.col("product_group_id")
        ),
        "duplicate_variant_combination": say(
            "상품 그룹 '{}'에서 색상 '{}', 사이즈 {} 조합이 여러 상품 ID에 중복되어 있습니다. 조합의 행: {}개, 첫 행: {}.",
            _arg("group"), _arg("color"), shown_size, count, first_row,
        ),
        "missing_required_field": say("필수 항목 '{}' 값이 누락되었습니다.", _arg("field")),
        "non_standard_color": say("색상 '{}'은 표준값 '{}'으로 통일하는 것이 좋습니다.", value, _arg("standard")),
        "non_standard_size": say("사이즈 '{}'은 표준값 '{}'으로 통일하는 것이 좋습니다.", value, _arg("standard")),
        "duplicate_product_content": say(
            "상품 ID '{}'(그룹 '{}')는 상품 ID '{}'(그룹 '{}')와 상품명, 카테고리, 색상, 사이즈, 가격이 모두 같습니다.",
            _arg("id"), _arg("group"), _arg("first_id"), _arg("first_group"),
        ),
        "invalid_category": say("카테고리 '{}'는 허용된 카테고리가 아닙니다.", value),
        "invalid_stock": F.coalesce(
            say("재고 {}개는 음수이므로 사용할 수 없습니다.", value), F.lit("재고가 누락되었거나 숫자 형식이 아닙니다.")
        ),
        "out_of_stock": F.lit("재고가 0개인 품절 상품입니다."),
        "invalid_price": F.lit("가격이 누락되었거나 숫자 형식이 아닙니다."),
        "invalid_non_positive_price": say("상품 가격이 0 이하입니다. 현재 가격: {}원.", with_commas(value)),
        "invalid_sale_price": F.lit("할인가가 누락되었거나 숫자 형식이 아닙니다."),
        "invalid_non_positive_sale_price": say("할인가가 0 이하입니다. 현재 할인가: {}원.", with_commas(value)),
        "sale_price_greater_than_price": say(
            "할인가 {}원이 정상가 {}원보다 큽니다.", with_commas(value), with_commas(_arg("price"))
        ),
        "category_price_anomaly": say(
            "같은 카테고리의 일반적인 가격 범위와 큰 차이가 있습니다. 현재 가격 {}원은 {} 카테고리 중앙값 {}원의 {}배입니다.",
            with_commas(_arg("price")), _arg("category"), median, short_number(_arg("ratio").cast("double")),
        ),
        "product_category_mismatch": say(
            "상품명에서 '{}'가 확인되어 {} 상품으로 추정되지만 현재 카테고리는 '{}'입니다.",
            _arg("keyword"), _arg("implied"), _arg("current"),
        ),
    }
    chain = F
    for rule, sentence in sentences.items():
        chain = chain.when(F.col("rule") == rule, sentence)
    return F.coalesce(chain, F.col("message"))


def report(issues: DataFrame) -> DataFrame:
    """Display columns of issues, plus the sort position (``severity_rank`` and the discovery order)."""
    labels, advice, risks = ({rule: texts[i] for rule, texts in RULE_CARDS.items()} for i in range(3))
    rule = F.col("rule")
    return issues.select(
        F.coalesce(lookup_in(SEVERITY_LABELS, F.col("severity")), F.col("severity")).alias("status"),
        F.coalesce(lookup_in(labels, rule), rule).alias("error_field"),
        "product_group_id",
        "product_id",
        reason_text().alias("reason"),
        F.coalesce(lookup_in(advice, rule), F.lit(DEFAULT_RECOMMENDATION)).alias("recommendation"),
        F.coalesce(lookup_in(risks, rule), F.lit("")).alias("risk_level"),
        severity_rank(F.col("severity")).alias("severity_rank"),
        *DISCOVERY_ORDER,
    )


def in_report_order(reported: DataFrame) -> DataFrame:
    """Errors, then warnings, then others; discovery order within each.

    A sort reads its input twice, first for a sample: the issues are dealt out before, so that they are found only once.
    """
    return spread(reported, *DISCOVERY_ORDER).orderBy("severity_rank", *DISCOVERY_ORDER)


def count_by_rule(reported: DataFrame) -> DataFrame:
    label = strip(F.col("error_field"))
    return (
        reported.groupBy(F.when(label == "", F.lit(UNCLASSIFIED_RULE)).otherwise(label).alias("error_field"))
        .agg(F.count(F.lit(1)).alias("issue_count"))
        .orderBy(F.desc("issue_count"), "error_field")
    )


def count_by_risk(reported: DataFrame) -> DataFrame:
    risk = strip(F.col("risk_level"))
    known = F.when(risk.isin(*RISK_ORDER), risk).otherwise(F.lit(RISK_ORDER[-1]))
    place = F.array_position(F.lit(list(RISK_ORDER)), F.col("risk_level"))
    return (
        reported.groupBy(known.alias("risk_level")).agg(F.count(F.lit(1)).alias("issue_count")).orderBy(place)
    )


def count_by_product(reported: DataFrame) -> DataFrame:
    """Issue counts per product id, most first; the blank id is its own group and last among equals."""
    counts = reported.groupBy(strip(F.col("product_id")).alias("id")).agg(F.count(F.lit(1)).alias("issue_count"))
    shown = (
        F.when(F.col("id") == "", F.lit(NO_PRODUCT_ID))
        .when(F.col("id") == NO_PRODUCT_ID, F.lit(NO_PRODUCT_ID_AS_INPUT))
        .otherwise(F.col("id"))
    )
    ranked = counts.orderBy(F.desc("issue_count"), F.col("id") == "", "id")
    return ranked.select(shown.alias("product_id"), "issue_count")


def filter_issues(reported: DataFrame, status: str | None = None, rule_label: str | None = None,
                  product_id_part: str = "") -> DataFrame:
    """Keep issues by status, rule label and a literal, case-insensitive part of the product id."""
    kept = reported
    if status is not None:
        kept = kept.where(F.col("status") == status)
    if rule_label is not None:
        kept = kept.where(F.col("error_field") == rule_label)
    part = product_id_part.strip()
    if part:
        kept = kept.where(F.contains(F.lower(F.coalesce("product_id", F.lit(""))), F.lower(F.lit(part))))
    return kept


def overall_status(error_count: Column, warning_count: Column) -> Column:
    return (
        F.when(error_count > 0, F.lit(STATUS_ERROR))
        .when(warning_count > 0, F.lit(STATUS_WARNING))
        .otherwise(F.lit(STATUS_NORMAL))
    )


def safe_cell(value: Column) -> Column:
    """Text a spreadsheet will not run as a formula. Text already protected by ' starts with ' and is left alone."""
    return F.when(value.rlike(FORMULA_START), F.concat(F.lit("'"), value)).otherwise(value)


def export_safe(table: DataFrame) -> DataFrame:
    """All string columns made safe for spreadsheets."""
    texts = [f.name for f in table.schema.fields if isinstance(f.dataType, StringType)]
    return table.withColumns({name: safe_cell(F.col(name)) for name in texts})
