"""Product and category lists, settings, and what deleting a product or category does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import NO_CATEGORY, NO_CATEGORY_ID, PAY_KEY


def setting(t, key: str = PAY_KEY) -> Column:
    """Value of a setting as a scalar subquery, '' when it is missing."""
    return setting_value(t, key).select("value").scalar()


def setting_value(t, key: str = PAY_KEY) -> DataFrame:
    """One row with the value of a setting, '' when it is missing."""
    found = t.settings.where(F.col("key") == key).agg(F.max("value").alias("value"))
    return found.select(F.lit(key).alias("key"), F.coalesce("value", F.lit("")).alias("value"))


def active_categories(t, ordered: bool = True) -> DataFrame:
    listed = t.categories.where("active").select("id", "title", "icon_data_url", "active")
    return listed.orderBy("title", "id") if ordered else listed


def categories_admin(t, ordered: bool = True) -> DataFrame:
    """All categories, active first."""
    listed = t.categories.select("id", "title", "icon_data_url", "active", "created_at")
    return listed.orderBy(F.col("active").desc(), "title", "id") if ordered else listed


def _with_category(products: DataFrame, t) -> DataFrame:
    categories = t.categories.select(
        F.col("id").alias("category_id"), F.col("title").alias("_title"), F.col("icon_data_url").alias("_icon")
    )
    return products.join(categories, "category_id", "left")


def active_catalog(t, ordered: bool = True) -> DataFrame:
    """Active products with category title and icon; an inactive category's title still shows."""
    listed = _with_category(t.products.where("active"), t).select(
        "id", "name", "description", "price", "category_id",
        F.coalesce("_title", F.lit(NO_CATEGORY)).alias("category_title"),
        F.coalesce("_icon", F.lit("")).alias("category_icon_data_url"),
        "icon_data_url", "excluded_from_revenue", "active",
    )
    return listed.orderBy("category_title", "name", "id") if ordered else listed


def catalog_admin(t, ordered: bool = True) -> DataFrame:
    """All products, active first; uncategorised ones sort before all titles but show the default."""
    listed = _with_category(t.products, t).select(
        "id", "name", "description", "price", "category_id",
        F.coalesce("_title", F.lit(NO_CATEGORY)).alias("category_title"),
        "icon_data_url", "excluded_from_revenue", "active", "created_at", "_title",
    )
    if ordered:
        listed = listed.orderBy(F.col("active").desc(), F.coalesce("_title", F.lit("")), "name", "id")
    return listed.drop("_title")


def category_products(t, category_id: str = NO_CATEGORY_ID) -> DataFrame:
    """Active products of one tile; products without a category are in the tile 'none'."""
    bucket = F.coalesce(F.col("category_id"), F.lit(NO_CATEGORY_ID))
    return active_catalog(t, ordered=False).where(bucket == category_id)


def category_tiles(t, ordered: bool = True) -> DataFrame:
    """Number of active products per category, with the bucket 'none' for those without one.

    Products are counted per category before the category's title and icon are looked up.
    """
    counts = t.products.where("active").groupBy("category_id").agg(F.count("*").alias("products"))
    tiles = _with_category(counts, t).select(
        F.coalesce("category_id", F.lit(NO_CATEGORY_ID)).alias("category_id"),
        F.coalesce("_title", F.lit(NO_CATEGORY)).alias("title"),
        F.coalesce("_icon", F.lit("")).alias("icon_data_url"),
        "products",
    )
    return tiles.orderBy(F.expr("collate(title, 'de')"), "category_id") if ordered else tiles


def category_product_count(t) -> DataFrame:
    """Products in any state per category; empty categories have 0."""
    counts = t.products.groupBy("category_id").agg(F.count("*").alias("n"))
    return t.categories.join(counts, F.col("id") == F.col("category_id"), "left").select(
        "id", "title", "active", F.coalesce("n", F.lit(0).cast("bigint")).alias("product_count")
    )


def product_delete_plan(t, candidates: DataFrame | None = None) -> DataFrame:
    """What deleting each product does: with purchases it is deactivated, without any it is removed."""
    products = (t.products if candidates is None else candidates).select("id")
    bought = t.entries.select(F.col("product_id").alias("id")).distinct().withColumn("bought", F.lit(True))
    action = F.when(F.col("bought"), "deactivate").otherwise("remove")
    return products.join(bought, "id", "left").select(F.col("id").alias("product_id"), action.alias("action"))


def detach_category(t, deleted: DataFrame, remove: bool = False) -> tuple[DataFrame, DataFrame]:
    """(products, categories) after deleting categories: products lose the id, categories go inactive.

    The second version took the categories out of the table instead: ``remove``.
    """
    gone = deleted.select("id").distinct().withColumn("_gone", F.lit(True))
    products = t.products.join(gone.withColumnRenamed("id", "category_id"), "category_id", "left")
    products = products.withColumn("category_id", F.when(F.col("_gone").isNull(), F.col("category_id")))
    categories = t.categories.join(gone, "id", "left")
    if remove:
        categories = categories.where(F.col("_gone").isNull())
    categories = categories.withColumn("active", F.col("active") & F.col("_gone").isNull())
    return products.select(*t.products.columns), categories.select(*t.categories.columns)
