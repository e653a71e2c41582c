"""Mapping profiles: how a supplier's columns become the standard ones."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalake.functions.vocabulary import STANDARD_COLUMNS


@dataclass(frozen=True)
class Profile:
    name: str
    version: str
    targets: dict[str, tuple[str, ...]]  # source column -> standard columns it feeds
    required: tuple[str, ...]  # source columns that must be filled, in reporting order
    defaults: dict[str, str]  # standard column -> value for blanks

    def __post_init__(self) -> None:
        unknown = {t for targets in self.targets.values() for t in targets} | set(self.defaults)
        unknown -= set(STANDARD_COLUMNS)
        if unknown:
            raise ValueError(f"not standard columns: {sorted(unknown)}")

    @property
    def sources(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.targets, *self.required)))

    def canonical_json(self) -> str:
        """The parts that decide the result, as JSON with sorted keys."""
        payload = {
            "source_columns": {source: list(targets) for source, targets in self.targets.items()},
            "required_source_columns": list(self.required),
            "defaults": dict(self.defaults),
        }
        return json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


# The published sample profiles (their versions differ in name only).
_FASHION = {
    "vendor_sku": ("product_group_id", "product_id"),
    "item_name": ("product_name",),
    "main_category": ("category",),
    "brand_name": ("seller",),
    "list_price": ("price",),
    "discount_price": ("sale_price",),
    "colour": ("color",),
    "size_name": ("size",),
    "quantity": ("stock",),
    "description_text": ("description",),
    "image_link": ("image_path",),
}
_FASHION_REQUIRED = (
    "vendor_sku", "item_name", "main_category", "list_price", "colour", "size_name", "image_link",
)
_MARKETPLACE = {
    "style_id": ("product_group_id",),
    "sku_code": ("product_id",),
    "title": ("product_name",),
    "category_code": ("category",),
    "label": ("seller",),
    "regular_price": ("price",),
    "promo_price": ("sale_price",),
    "tone": ("color",),
    "fit_size": ("size",),
    "available_qty": ("stock",),
    "details": ("description",),
    "photo": ("image_path",),
}
_MARKETPLACE_REQUIRED = (
    "style_id", "sku_code", "title", "category_code", "label", "regular_price", "tone", "fit_size", "photo",
)
PUBLISHED = {
    ("sample_fashion_vendor", "1"): "917268b6c9c860504a8e3843d7943559e218c51f2e1d856dc511e2de794e22b1",
    ("sample_fashion_vendor", "2"): "917268b6c9c860504a8e3843d7943559e218c51f2e1d856dc511e2de794e22b1",
    ("sample_marketplace_vendor", "1"): "43f7ece4069c964dbb0b90b8e4530b74f3f417f461b2be2f70f59511e9c31608",
    ("sample_marketplace_vendor", "2"): "43f7ece4069c964dbb0b90b8e4530b74f3f417f461b2be2f70f59511e9c31608",
}

PROFILES = {
    (name, version): Profile(name, version, targets, required, {"stock": "0"})
    for name, targets, required in (
        ("sample_fashion_vendor", _FASHION, _FASHION_REQUIRED),
        ("sample_marketplace_vendor", _MARKETPLACE, _MARKETPLACE_REQUIRED),
    )
    for version in ("1", "2")
}
FASHION = PROFILES["sample_fashion_vendor", "2"]
MARKETPLACE = PROFILES["sample_marketplace_vendor", "2"]


def profile_rows(spark: SparkSession, profiles: dict[tuple[str, str], Profile] = PROFILES) -> DataFrame:
    """One row per profile version with its canonical text."""
    rows = [(p.name, p.version, p.canonical_json()) for p in profiles.values()]
    return spark.createDataFrame(rows, "profile_name string, profile_version string, canonical string")


def changed_profiles(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Published versions whose content changed, or versions without a published fingerprint."""
    now = current.select("profile_name", "profile_version", F.sha2("canonical", 256).alias("fingerprint"))
    known = baseline.withColumnRenamed("fingerprint", "published")
    joined = now.join(known, ["profile_name", "profile_version"], "left")
    return joined.where(~F.col("fingerprint").eqNullSafe(F.col("published")))
