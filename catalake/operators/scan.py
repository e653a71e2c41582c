"""Personal-data search and masking over tables of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from catalake.functions import privacy
from catalake.functions.vocabulary import DEFAULT, UNMASKED_COLUMNS, Vocabulary


def fields_long(table: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One row per text field: key columns, field, place of the field, text."""
    entries = [
        F.struct(F.lit(name).alias("field"), F.lit(i).alias("place"), F.coalesce(F.col(name), F.lit("")).alias("text"))
        for i, name in enumerate(fields)
    ]
    return table.select(*key, F.inline(F.array(*entries))).where(F.col("text") != "")


def _found(texts: DataFrame, values: Column) -> DataFrame:
    kept = [name for name in texts.columns if name != "text"]
    return texts.select(*kept, F.posexplode(values).alias("pos", "value"))


def scan_terms(texts: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return _found(texts, privacy.find_terms(F.col("text"), vocab.prohibited_terms))


def scan_emails(texts: DataFrame) -> DataFrame:
    return _found(texts, privacy.find_emails(F.col("text"))).withColumn("masked", privacy.mask_email(F.col("value")))


def scan_phones(texts: DataFrame) -> DataFrame:
    return _found(texts, privacy.find_phones(F.col("text"))).withColumn("masked", privacy.mask_phone(F.col("value")))


def scan_residents(texts: DataFrame) -> DataFrame:
    found = _found(texts, privacy.find_residents(F.col("text")))
    return found.withColumn("masked", privacy.mask_resident(F.col("value")))


def scan_accounts(texts: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    found = _found(texts, privacy.find_accounts(F.col("text"), vocab))
    return found.withColumn("masked", privacy.mask_account(F.col("value")))


def mask_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.withColumns({name: privacy.mask_personal(F.col(name)) for name in columns})


def mask_table(table: DataFrame, keep: tuple[str, ...] = UNMASKED_COLUMNS) -> DataFrame:
    """All string columns masked, except ids and numbers."""
    texts = [f.name for f in table.schema.fields if isinstance(f.dataType, StringType) and f.name not in keep]
    return mask_columns(table, texts)


def mask_source_map(values: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """Every value of a source map with personal data and account numbers masked; NULL becomes ''."""
    return F.transform_values(values, lambda _, v: privacy.mask_sensitive(F.coalesce(v, F.lit("")), vocab))
