"""Money expressions. Amounts are decimal(10,2); sums are decimal(28,2) so that they cannot overflow
at 10^12 rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(10,2)"
TOTAL = "decimal(28,2)"
NO_BREAK_SPACE = "\u00a0"


def zero() -> Column:
    return F.lit(0).cast(TOTAL)


def or_zero(value) -> Column:
    """A missing sum counts as 0."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0)).cast(TOTAL)


def money_sum(value, where: Column | None = None) -> Column:
    """Exact sum of an amount column, over the rows that satisfy ``where``; 0 when there are none."""
    amount = (F.col(value) if isinstance(value, str) else value).cast("decimal(18,2)")
    return or_zero(F.sum(amount if where is None else F.when(where, amount)))


def unit_sum(value, where: Column | None = None) -> Column:
    """Bigint sum of a quantity column; 0 when there are no rows."""
    units = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    return F.coalesce(F.sum(units if where is None else F.when(where, units)), F.lit(0).cast("bigint"))


def booked_total() -> Column:
    """Quantity times the price at booking time; never recomputed from the current price."""
    return (F.col("quantity") * F.col("unit_price")).cast(AMOUNT)


def amount_due(balance) -> Column:
    """What a member owes: the debt as a positive amount, else 0."""
    return F.greatest(-F.col(balance), zero()).cast(TOTAL)


def euro_text(value) -> Column:
    """Money in German notation: ``1.234,56 €`` with a no-break space."""
    plain = F.format_number(F.col(value) if isinstance(value, str) else value, 2)
    return F.concat(F.translate(plain, ",.", ".,"), F.lit(f"{NO_BREAK_SPACE}€"))
