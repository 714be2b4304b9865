"""Revenue reports.

Deliberate differences between the figures: products left out of revenue keep their units but have
revenue 0; the summary's units count them too; products without a category are in no category row.

All three reports come from one scan of the purchases, aggregated per product before any join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import TOTAL, money_sum, or_zero, unit_sum, zero
from tallybook.functions.months import in_month, month_label
from tallybook.functions.text import NO_CATEGORY
from tallybook.operators.movements import live

_FIGURES = ("month_units", "month_revenue", "all_units", "all_revenue")


def product_sales(t, as_of: dt.date) -> DataFrame:
    """Units and totals per product with live purchases, for the month and overall."""
    month = in_month("created_at", as_of)
    return (
        t.entries.where(live()).groupBy("product_id")
        .agg(
            unit_sum("quantity", month).alias("month_units"), money_sum("total", month).alias("month_revenue"),
            unit_sum("quantity").alias("all_units"), money_sum("total").alias("all_revenue"),
        )
    )


def _sales_of_all_products(t, as_of: dt.date, exclusion: bool = True) -> DataFrame:
    """Sales of every product, 0 for unsold ones; with ``exclusion`` revenue of left-out products is 0."""
    sales = product_sales(t, as_of)
    products = t.products.select(
        F.col("id").alias("product_id"), F.col("name"), "price", "category_id",
        F.coalesce("excluded_from_revenue", F.lit(False)).alias("excluded_from_revenue"),
    )
    counted = F.lit(True) if not exclusion else ~F.col("excluded_from_revenue")
    figures = [
        F.coalesce(f, F.lit(0).cast("bigint")).alias(f) if f.endswith("units")
        else F.when(counted, or_zero(f)).otherwise(zero()).alias(f)
        for f in _FIGURES
    ]
    return products.join(sales, "product_id", "left").select(*products.columns, *figures)


def revenue_summary(t, as_of: dt.date) -> DataFrame:
    """Month revenue and all-time revenue without left-out products; month units with them."""
    sales = product_sales(t, as_of)
    excluded = t.products.select(
        F.col("id").alias("product_id"),
        F.coalesce("excluded_from_revenue", F.lit(False)).alias("excluded"),
    )
    counted = ~F.col("excluded")
    return sales.join(excluded, "product_id", "left").agg(
        _total("month_revenue", counted), F.coalesce(F.sum("month_units"), F.lit(0).cast("bigint")).alias("month_units"),
        _total("all_revenue", counted),
    )


def _total(column: str, where=None):
    value = F.col(column) if where is None else F.when(where, F.col(column))
    return or_zero(F.sum(value)).alias(column)


def product_analysis(t, as_of: dt.date, ordered: bool = True) -> DataFrame:
    """Units and revenue per product, inactive ones included; highest month revenue first."""
    report = _title_of(t, _sales_of_all_products(t, as_of)).select(
        "product_id", "name", "category", "excluded_from_revenue", *_FIGURES
    )
    return report.orderBy(F.col("month_revenue").desc(), "product_id") if ordered else report


def _title_of(t, products: DataFrame) -> DataFrame:
    titles = t.categories.select(F.col("id").alias("category_id"), F.col("title").alias("_title"))
    joined = products.join(titles, "category_id", "left")
    return joined.withColumn("category", F.coalesce("_title", F.lit(NO_CATEGORY))).drop("_title")


def _by_category(t, products: DataFrame) -> DataFrame:
    sums = products.groupBy("category_id").agg(
        *(F.sum(f).cast("bigint" if f.endswith("units") else TOTAL).alias(f) for f in _FIGURES)
    )
    categories = t.categories.select(F.col("id").alias("category_id"), "title")
    figures = [
        F.coalesce(f, F.lit(0).cast("bigint")).alias(f) if f.endswith("units") else or_zero(f).alias(f)
        for f in _FIGURES
    ]
    return categories.join(sums, "category_id", "left").select("category_id", "title", *figures)


def category_analysis(t, as_of: dt.date, ordered: bool = True) -> DataFrame:
    """Per category: month units with left-out products, revenue without; every category listed."""
    report = _by_category(t, _sales_of_all_products(t, as_of)).drop("all_units")
    return report.orderBy(F.col("month_revenue").desc(), "category_id") if ordered else report


def legacy_products(t, as_of: dt.date, ordered: bool = True) -> DataFrame:
    """Second-version product report: no exclusion, with the current price."""
    report = _title_of(t, _sales_of_all_products(t, as_of, exclusion=False)).select(
        "product_id", "name", "category", "price", *_FIGURES
    )
    return report.orderBy(F.col("month_revenue").desc(), "product_id") if ordered else report


def legacy_categories(t, as_of: dt.date, ordered: bool = True) -> DataFrame:
    """Second-version category report: no exclusion, with all-time units."""
    report = _by_category(t, _sales_of_all_products(t, as_of, exclusion=False))
    return report.orderBy(F.col("month_revenue").desc(), "category_id") if ordered else report


def legacy_totals(t, as_of: dt.date) -> DataFrame:
    """Second-version totals: all live purchases, no exclusion, with the month's name."""
    return t.entries.where(live()).agg(
        money_sum("total").alias("total_revenue"),
        money_sum("total", in_month("created_at", as_of)).alias("month_revenue"),
    ).select(month_label(as_of).alias("month_label"), "total_revenue", "month_revenue")


def product_bar_share(t, as_of: dt.date) -> DataFrame:
    """Bar width in percent of the best product of the month, at least 3.

    The best product's revenue is a scalar subquery, not a window over all products.
    """
    products = product_analysis(t, as_of, ordered=False).select("product_id", "name", "month_revenue")
    best = products.agg(F.max("month_revenue").alias("best")).scalar()
    share = F.col("month_revenue").cast("double") / F.greatest(best.cast("double"), F.lit(1.0)) * 100
    return products.withColumn("bar_percent", F.greatest(share, F.lit(3.0)))
