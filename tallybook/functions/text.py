"""Text expressions: member keys, pay handles, pay links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PAY_KEY = "paypal_me"
PAY_LINK = "https://paypal.me/"
PAY_PATTERN = r"(?i)^(?:https?://(?:www\.)?paypal\.me/)?(?:paypal\.me/)?@?([^?#/]*)"
HANDLE_PATTERN = r"^([A-Za-z0-9._-]{3,80})?\z"  # an empty handle clears the setting
IMAGE_PATTERN = "^data:image/(jpeg|png|webp);base64,"
NO_CATEGORY = "Ohne Kategorie"
DEFAULT_CATEGORY = "Allgemein"
NO_CATEGORY_ID = "none"


def key_from_name(role, name) -> Column:
    """Member key derived from the name; admins get ``admin``."""
    letters = F.regexp_replace(name, "[^a-zA-Z0-9]+", "")
    return F.when(F.col(role) == "admin", "admin").otherwise(F.lower(letters))


def suffixed_key(key, member_id) -> Column:
    """Key with the first four characters of the id, for members whose key is not unique."""
    stem = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("user"))
    return F.concat(stem, F.lit("-"), F.substring(F.col(member_id).cast("string"), 1, 4))


def pay_handle(raw) -> Column:
    """Bare handle from a pay URL, ``@name`` or name; everything after ``/``, ``?`` or ``#`` is cut.

    One pattern instead of one replacement per prefix: Spark repeats an expression wherever its
    result is used, so it should be small.
    """
    return F.regexp_extract(F.trim(F.coalesce(F.col(raw), F.lit(""))), PAY_PATTERN, 1)


def pay_link(handle: Column, due) -> Column:
    """Pay link with the amount due; without a handle there is no link, without a debt no amount."""
    amount = F.when(F.col(due) > 0, F.concat(F.lit("/"), F.col(due).cast("decimal(28,2)").cast("string")))
    return F.when(handle == "", "").otherwise(
        F.concat(F.lit(PAY_LINK), F.url_encode(handle), F.coalesce(amount, F.lit("")))
    )
