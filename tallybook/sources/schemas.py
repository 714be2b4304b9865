"""Declared schemas of the thirteen tables. Login secrets are not part of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(10, 2)
_TIME = T.TimestampNTZType()


def _schema(*columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


_S, _B, _I = T.StringType(), T.BooleanType(), T.IntegerType()

SCHEMAS: dict[str, T.StructType] = {
    "users": _schema(
        ("id", _S), ("user_key", _S), ("name", _S), ("role", _S), ("active", _B),
        ("created_at", _TIME), ("updated_at", _TIME),
    ),
    "categories": _schema(
        ("id", _S), ("title", _S), ("icon_data_url", _S), ("active", _B),
        ("created_at", _TIME), ("updated_at", _TIME),
    ),
    "products": _schema(
        ("id", _S), ("name", _S), ("description", _S), ("price", _MONEY), ("category_id", _S),
        ("icon_data_url", _S), ("excluded_from_revenue", _B), ("active", _B),
        ("created_at", _TIME), ("updated_at", _TIME),
    ),
    "entries": _schema(
        ("id", _S), ("user_id", _S), ("product_id", _S), ("quantity", _I), ("unit_price", _MONEY),
        ("total", _MONEY), ("paid", _B), ("paid_at", _TIME), ("deleted_at", _TIME),
        ("deleted_by", _S), ("deleted_reason", _S), ("created_at", _TIME),
    ),
    "payments": _schema(
        ("id", _S), ("user_id", _S), ("amount", _MONEY), ("note", _S), ("created_by", _S),
        ("created_at", _TIME),
    ),
    "adjustments": _schema(
        ("id", _S), ("user_id", _S), ("amount", _MONEY), ("note", _S), ("created_by", _S),
        ("created_at", _TIME),
    ),
    "settings": _schema(("key", _S), ("value", _S), ("updated_by", _S), ("updated_at", _TIME)),
    "suggestions": _schema(
        ("id", _S), ("title", _S), ("description", _S), ("status", _S), ("created_by", _S),
        ("created_at", _TIME), ("updated_at", _TIME),
    ),
    "suggestion_votes": _schema(("suggestion_id", _S), ("user_id", _S), ("created_at", _TIME)),
    "news": _schema(
        ("id", _S), ("title", _S), ("body", _S), ("image_data_url", _S), ("created_by", _S),
        ("created_at", _TIME), ("updated_at", _TIME),
    ),
    "news_likes": _schema(("news_id", _S), ("user_id", _S), ("created_at", _TIME)),
    "news_comments": _schema(
        ("id", _S), ("news_id", _S), ("user_id", _S), ("body", _S), ("created_at", _TIME),
    ),
    "news_reads": _schema(("user_id", _S), ("last_seen_at", _TIME)),
}

# Ledger tables grow with every booking and are stored by month.
MONTHLY = ("entries", "payments", "adjustments")
