"""Deep pages by a seek: marks into the order of a table, then a filter on (key, id) instead of skipped rows.

``offset + limit`` brings every skipped row to one task.  Here the order is laid out once by a range exchange (no window,
no single task) and every ``step``-th row's key is a mark: n / step rows, stored where wanted.  A page starts at the mark at
or before its offset, which is less than ``step`` rows away: its key becomes a filter that reaches the scan, and a top-k
of fewer than ``step + limit`` rows does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelake.operators.ids import ranked

#: columns of an order, each with True where it descends; the last one is unique
Order = list[tuple[str, bool]]


def _by(order: Order) -> list[F.Column]:
    return [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]


def page_marks(df: DataFrame, order: Order, step: int = 1000, num_buckets: int | None = None) -> DataFrame:
    """(rank from 0, key columns) of every ``step``-th row; keys must not be null."""
    keys = [c for c, _ in order]
    rows = ranked(df.select(*keys).dropna(), _by(order), "rank", num_buckets)
    return rows.where(F.col("rank") % step == 0).select("rank", *keys)


def _from(order: Order, key: dict) -> F.Column:
    """Rows at or after ``key``: the first column's bound stands alone, so that it can be pushed to the scan."""
    def past(c: str, desc: bool, strict: bool) -> F.Column:
        v = F.lit(key[c])
        return (F.col(c) < v if desc else F.col(c) > v) if strict else (F.col(c) <= v if desc else F.col(c) >= v)

    exact = past(*order[-1], False)
    for c, desc in reversed(order[:-1]):
        exact = past(c, desc, True) | ((F.col(c) == F.lit(key[c])) & exact)
    return past(*order[0], False) & exact


def seek_page(df: DataFrame, order: Order, marks: DataFrame, offset: int, limit: int) -> DataFrame:
    """The ``limit`` rows after ``offset`` rows in the order; none past the end."""
    mark = marks.where(F.col("rank") <= offset).orderBy(F.desc("rank")).first()  # one row
    if mark is None:
        return df.where("false")
    rows = df.where(_from(order, mark.asDict())).orderBy(*_by(order))
    return rows.offset(offset - mark["rank"]).limit(limit)
