"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgelake.functions import rules


def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from text or ``datetime`` (no session time zone involved)."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    return F.expr(f"TIMESTAMP_NTZ '{value}'")


def date_lit(value) -> Column:
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, (_dt.date, _dt.datetime)):
        value = value.strftime("%Y-%m-%d")
    return F.expr(f"DATE '{value}'")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# English month abbreviations used in every date text.
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Date texts are assembled from calendar fields, which are time-zone free on DATE and
# TIMESTAMP_NTZ (date_format would cast to the session zone first, and DST gaps would shift
# wall-clock times) and locale free (month names are fixed).


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def month_name(c) -> Column:
    """'MMM': Jan .. Dec."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_ABBR]), F.month(col_(c)))


def day_fmt(c) -> Column:
    """'dd MMM yyyy', e.g. '05 Jan 2026'."""
    c = col_(c)
    return F.concat(_pad(F.dayofmonth(c), 2), F.lit(" "), month_name(c), F.lit(" "), _pad(F.year(c), 4))


def day_time_fmt(c) -> Column:
    """"dd MMM yyyy 'at' hh:mm a", e.g. '05 Jan 2026 at 05:09 PM'."""
    c = col_(c)
    h = F.hour(c)
    return F.concat(day_fmt(c), F.lit(" at "), _pad((h + 11) % 12 + 1, 2), F.lit(":"), _pad(F.minute(c), 2),
                    F.when(h < 12, F.lit(" AM")).otherwise(F.lit(" PM")))


def month_key(c) -> Column:
    """'yyyy-MM'."""
    c = col_(c)
    return F.concat(_pad(F.year(c), 4), F.lit("-"), _pad(F.month(c), 2))


def iso_day(c) -> Column:
    """'yyyy-MM-dd'."""
    c = col_(c)
    return F.concat(month_key(c), F.lit("-"), _pad(F.dayofmonth(c), 2))


def is_peak(check_in) -> Column:
    """Peak season is decided by the check-in month alone."""
    return F.month(col_(check_in)).isin(*rules.PEAK_MONTHS)


def season_name(check_in) -> Column:
    return F.when(is_peak(check_in), F.lit(rules.PEAK_NAME)).otherwise(F.lit(rules.OFFPEAK_NAME))


def advance_days(check_in, at) -> Column:
    """Whole days from ``at`` to check-in midnight, floored, never negative."""
    gap = F.timestamp_diff("DAY", col_(at), col_(check_in).cast("timestamp_ntz"))
    return F.greatest(F.lit(0).cast("long"), gap)


def discount_percent(days) -> Column:
    d = col_(days)
    expr = F.lit(0)
    for lo, hi, pct, _ in reversed(rules.ADVANCE_DISCOUNT_TIERS):
        expr = F.when(d.between(lo, hi), F.lit(pct)).otherwise(expr)
    return expr


def discount_label(days) -> Column:
    d = col_(days)
    expr = F.lit(rules.NO_DISCOUNT_LABEL)
    for lo, hi, _, label in reversed(rules.ADVANCE_DISCOUNT_TIERS):
        expr = F.when(d.between(lo, hi), F.lit(label)).otherwise(expr)
    return expr


def refund_charge_rate(days) -> Column:
    d = col_(days)
    expr = None
    for lo, rate, _ in rules.REFUND_TIERS:
        lit = F.lit(rate).cast("decimal(3,2)")
        expr = F.when(d >= lo, lit) if expr is None else expr.when(d >= lo, lit)
    return expr.otherwise(F.lit(rules.REFUND_TIERS[-1][1]).cast("decimal(3,2)"))


def refund_policy(days) -> Column:
    d = col_(days)
    expr = None
    for lo, _, text in rules.REFUND_TIERS:
        lit = F.lit(rules.REFUND_POLICY_PREFIX + text)
        expr = F.when(d >= lo, lit) if expr is None else expr.when(d >= lo, lit)
    return expr.otherwise(F.lit(rules.REFUND_POLICY_PREFIX + rules.REFUND_TIERS[-1][2]))


def money(c) -> Column:
    """'£12.50' text; ``%f`` needs a double, amounts are exact to the penny."""
    return F.format_string(rules.MONEY_FORMAT, col_(c).cast("double"))


def store_text(c) -> Column:
    """Text as the store compares it for equality: blind to case and accents.  For keys of joins, groups and filters,
    not for results."""
    return F.collate(col_(c), rules.STORE_COLLATION)


def plain_text(c) -> Column:
    """Text compared by its bytes again."""
    return F.collate(col_(c), "UTF8_BINARY")


def dec(c, p: int = 10, s: int = 2) -> Column:
    return col_(c).cast(f"decimal({p},{s})")


def blank_to_null(c) -> Column:
    c = col_(c)
    return F.when(c == "", F.lit(None)).otherwise(c)


def first_present(*cols, default: str = "N/A") -> Column:
    """``x or y or 'N/A'``: the first non-null, non-empty value."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(default))


def title_case(c) -> Column:
    return F.initcap(col_(c))
