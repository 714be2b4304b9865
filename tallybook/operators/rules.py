"""Validity rules. A rule is a name and a condition that is true for a row that breaks it."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import HANDLE_PATTERN, IMAGE_PATTERN, PAY_KEY
from tallybook.operators.members import duplicate_user_keys, shared_keys
from tallybook.session import stage

# Fixed values.
MAX_TITLE = 120
MAX_NEWS_BODY = 3000
MAX_IMAGE = 2_200_000
MAX_COMMENT = 500
STATUSES = ("open", "added", "rejected")
ROLES = ("admin", "user")
KEY_PATTERN = r"^[a-z0-9._-]+\z"

Rule = tuple[str, Column]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _trimmed_length(column: str) -> Column:
    return F.length(F.trim(_text(column)))


def user_rules(strict: bool = False) -> list[Rule]:
    """``strict`` is the second version: at least three characters from a fixed set."""
    key = F.lower(F.trim(_text("user_key")))
    rules = [
        ("user_key_too_short", F.length(key) < (3 if strict else 2)),
        ("name_too_short", _trimmed_length("name") < 2),
        ("role_invalid", ~_text("role").isin(*ROLES)),
    ]
    return [*rules, ("user_key_characters", ~key.rlike(KEY_PATTERN))] if strict else rules


def category_rules() -> list[Rule]:
    return [("title_too_short", _trimmed_length("title") < 2)]


def product_rules() -> list[Rule]:
    return [
        ("name_too_short", _trimmed_length("name") < 2),
        ("price_invalid", F.col("price").isNull() | (F.col("price") < 0)),
    ]


def entry_rules() -> list[Rule]:
    return [
        ("quantity_not_positive", F.col("quantity").isNull() | (F.col("quantity") <= 0)),
        ("unit_price_negative", F.col("unit_price").isNull() | (F.col("unit_price") < 0)),
        ("total_differs", ~F.col("total").eqNullSafe(F.col("quantity") * F.col("unit_price"))),
    ]


def payment_rules() -> list[Rule]:
    """The sign is checked before rounding, the stored amount after it."""
    return [
        ("amount_not_positive", F.col("amount").isNull() | (F.col("amount") <= 0)),
        ("amount_rounds_to_zero", F.round("amount", 2) <= 0),
    ]


def adjustment_rules() -> list[Rule]:
    """Only the unrounded amount must differ from 0, so 0.004 is stored as 0.00."""
    return [("amount_zero", F.col("amount").isNull() | (F.col("amount") == 0))]


def setting_rules() -> list[Rule]:
    return [("pay_handle_invalid", (F.col("key") == PAY_KEY) & ~_text("value").rlike(HANDLE_PATTERN))]


def suggestion_rules() -> list[Rule]:
    return [
        ("title_too_short", _trimmed_length("title") < 2),
        ("status_invalid", ~_text("status").isin(*STATUSES)),
    ]


def news_rules() -> list[Rule]:
    image = _text("image_data_url")
    return [
        ("title_too_short", _trimmed_length("title") < 2),
        ("title_too_long", _trimmed_length("title") > MAX_TITLE),
        ("body_empty", _trimmed_length("body") < 1),
        ("body_too_long", F.length(_text("body")) > MAX_NEWS_BODY),
        ("image_too_large", F.length(image) > MAX_IMAGE),
        ("image_format", (image != "") & ~image.rlike(IMAGE_PATTERN)),
    ]


def comment_rules() -> list[Rule]:
    return [
        ("body_empty", _trimmed_length("body") < 1),
        ("body_too_long", F.length(_text("body")) > MAX_COMMENT),
    ]


def broken_rules(rules: list[Rule]) -> Column:
    """Names of all rules a row breaks."""
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules)))


def first_broken(rules: list[Rule]) -> Column:
    """Name of the first rule a row breaks, null for a valid row."""
    return F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in rules))


class Reference(NamedTuple):
    """A column whose values have to be ids of a parent table, and the rule's name."""

    column: str
    parent: str
    rule: str


_MEMBER = Reference("user_id", "users", "user_unknown")
REFERENCES: dict[str, tuple[Reference, ...]] = {
    "entries": (_MEMBER, Reference("product_id", "products", "product_unknown")),
    "payments": (_MEMBER,),
    "adjustments": (_MEMBER,),
    "news_comments": (Reference("news_id", "news", "news_unknown"),),
    "suggestion_votes": (Reference("suggestion_id", "suggestions", "parent_unknown"),),
    "news_likes": (Reference("news_id", "news", "parent_unknown"),),
}


def unknown_keys(t) -> DataFrame:
    """(parent, key): references that the parent table lacks, found in one job that reads every table once.

    They are made distinct before they meet the parents, so a reference that holds a third of all rows is one row there.
    """
    used = [
        getattr(t, table).select(F.inline(F.array(*(
            F.struct(F.lit(r.parent).alias("parent"), F.col(r.column).cast("string").alias("key")) for r in references
        ))))
        for table, references in REFERENCES.items()
    ]
    parents = sorted({r.parent for references in REFERENCES.values() for r in references})
    known = [getattr(t, name).select(F.lit(name).alias("parent"), F.col("id").cast("string").alias("key")) for name in parents]
    keys = reduce(DataFrame.unionByName, used).where("key is not null").distinct()
    return stage(keys.join(reduce(DataFrame.unionByName, known), ["parent", "key"], "left_anti"), "unknown-references")


def _violations(table: str, frame: DataFrame, rules: list[Rule], row_id: Column, unknown: DataFrame | None = None) -> DataFrame:
    """All rules that rows of a table break, references included if their unknown keys are given, in one pass."""
    broken = broken_rules(rules) if rules else F.array().cast("array<string>")
    if unknown is not None:
        for r in REFERENCES[table]:
            missing = unknown.where(F.col("parent") == r.parent).select(F.col("key").alias(f"_{r.column}"))
            frame = frame.join(missing, F.col(r.column).cast("string") == F.col(f"_{r.column}"), "left")
        broken = F.concat(broken, F.array_compact(F.array(
            *(F.when(F.col(f"_{r.column}").isNotNull(), F.lit(r.rule)) for r in REFERENCES[table])
        )))
    return frame.select(F.lit(table).alias("table_name"), row_id.cast("string").alias("row_id"), F.explode(broken).alias("rule"))


def _marked(table: str, frame: DataFrame, rule: str, row_id: Column) -> DataFrame:
    return frame.select(F.lit(table).alias("table_name"), row_id.cast("string").alias("row_id"), F.lit(rule).alias("rule"))


def rule_violations(t) -> DataFrame:
    """(table_name, row_id, rule) for every broken rule in the thirteen tables."""
    row = F.col("id")

    def pair(item: str) -> Column:
        return F.concat_ws("/", F.col(item), F.col("user_id"))

    unknown = unknown_keys(t)
    found = [
        _violations("users", t.users, user_rules(), row),
        _marked("users", duplicate_user_keys(t.users), "user_key_not_unique", row),
        _violations("categories", t.categories, category_rules(), row),
        _violations("products", t.products, product_rules(), row),
        _violations("entries", t.entries, entry_rules(), row, unknown),
        _violations("payments", t.payments, payment_rules(), row, unknown),
        _violations("adjustments", t.adjustments, adjustment_rules(), row, unknown),
        _violations("settings", t.settings, setting_rules(), F.col("key")),
        _violations("suggestions", t.suggestions, suggestion_rules(), row),
        _violations("news", t.news, news_rules(), row),
        _violations("news_comments", t.news_comments, comment_rules(), row, unknown),
    ]
    for table, item in (("suggestion_votes", "suggestion_id"), ("news_likes", "news_id")):
        rows = getattr(t, table)
        repeated = rows.groupBy(item, "user_id").agg(F.count("*").alias("n")).where("n > 1")
        found.append(_marked(table, repeated, "pair_not_unique", pair(item)))
        found.append(_violations(table, rows, [], pair(item), unknown))
    return reduce(DataFrame.unionByName, found)


def _counters(rules: list[Rule]) -> list[Column]:
    return [F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules]


def _listed(table: str, sums: DataFrame) -> DataFrame:
    """(table_name, rule, rows) from one row with a counter per rule; rules that no row breaks are left out."""
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).cast("long").alias("rows")) for name in sums.columns))
    return sums.select(F.inline(pairs)).where("rows > 0").select(F.lit(table).alias("table_name"), "rule", "rows")


def _summed(keyed: DataFrame, reference: Reference, t) -> DataFrame:
    """One row: the sums of all counters over rows with one row per key, and the ``rows`` of keys that the parent lacks.

    Counters are summed per key before they meet the parent, so a key that holds a third of all rows is one row there.
    """
    known = getattr(t, reference.parent).select(F.col("id").alias("_id")).distinct()
    met = keyed.join(known, F.col(reference.column) == F.col("_id"), "left")
    lost = F.col("_id").isNull() & F.col(reference.column).isNotNull()
    counters = [F.sum(c).alias(c) for c in keyed.columns if c not in (reference.column, "rows")]
    return met.agg(*counters, F.sum(F.when(lost, F.col("rows"))).alias(reference.rule))


def rule_violation_counts(t) -> DataFrame:
    """(table_name, rule, rows): how many rows break each rule, for the rules that any breaks.

    Rules are counted in one read of their table, in the aggregate that counts the rows per referenced key. A second
    reference of a table reads its column once more. No rows are listed: ``rule_violations`` names them.
    """
    checked = {
        "users": user_rules(), "categories": category_rules(), "products": product_rules(), "entries": entry_rules(),
        "payments": payment_rules(), "adjustments": adjustment_rules(), "settings": setting_rules(),
        "suggestions": suggestion_rules(), "news": news_rules(), "news_comments": comment_rules(),
    }
    rows = F.count("*").alias("rows")
    found = [_listed("users", shared_keys(t.users).agg(F.sum("holders").alias("user_key_not_unique")))]
    for table, rules in checked.items():
        first, *others = REFERENCES.get(table, (None,))
        frame = getattr(t, table)
        if first is None:
            found.append(_listed(table, frame.agg(*_counters(rules))))
        else:
            found.append(_listed(table, _summed(frame.groupBy(first.column).agg(*_counters(rules), rows), first, t)))
        found += [_listed(table, _summed(frame.groupBy(r.column).agg(rows), r, t)) for r in others]
    for table, item in (("suggestion_votes", "suggestion_id"), ("news_likes", "news_id")):
        pairs = getattr(t, table).groupBy(item, "user_id").agg(rows)
        items = pairs.groupBy(item).agg(F.count_if(F.col("rows") > 1).alias("pair_not_unique"), F.sum("rows").alias("rows"))
        found.append(_listed(table, _summed(items, REFERENCES[table][0], t)))
    return reduce(DataFrame.unionByName, found)
