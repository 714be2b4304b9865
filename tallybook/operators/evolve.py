"""Products of the first version, which had fewer columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import DEFAULT_CATEGORY


def evolve_products(products: DataFrame, categories: DataFrame) -> DataFrame:
    """First-version products with the later columns; those without a category get the default one."""
    default = categories.where(F.col("title") == DEFAULT_CATEGORY).agg(F.min("id").alias("id")).scalar()
    kind = categories.schema["id"].dataType
    defaults = {
        "description": F.lit(""), "category_id": F.lit(None).cast(kind), "icon_data_url": F.lit(""),
        "excluded_from_revenue": F.lit(False), "updated_at": F.col("created_at"),
    }
    stored = {
        name: F.coalesce(F.col(name), value) if name in products.columns else value
        for name, value in defaults.items()
    }
    evolved = products.withColumns(stored)
    return evolved.withColumn("category_id", F.coalesce(F.col("category_id"), default))
