"""Normalized records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T

SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
NORMALIZED_COLUMNS = ["name_norm", "name_core", "address_norm", "country_norm", "postal_codes", "house_number", "address_numbers"]


def normalize_records(df: DataFrame) -> DataFrame:
    """df with the seven normalized columns; a projection without a shuffle. Nulls become ''."""
    names, addresses = F.col("name_norm"), F.col("address_norm")
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in SOURCE_COLUMNS[1:]})
    own = filled.withColumns({
        "name_norm": T.normalize_name(F.col("business_name")),
        "address_norm": T.normalize_address(F.col("business_address")),
        "country_norm": T.normalize_text(F.col("country")),
    })
    return own.withColumns({
        "name_core": T.name_core(names),
        "postal_codes": T.postal_codes(addresses),
        "house_number": T.house_number(addresses),
        "address_numbers": T.address_numbers(addresses),
    }).select(*df.columns, *NORMALIZED_COLUMNS)


def normalize_record(spark: SparkSession, record: dict[str, str]) -> dict[str, str]:
    """The normalized columns of one record."""
    row = [str(record.get(c) or "") for c in SOURCE_COLUMNS]
    return normalize_records(spark.createDataFrame([row], SOURCE_COLUMNS)).select(*NORMALIZED_COLUMNS).first().asDict()
