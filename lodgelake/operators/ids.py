"""Dense id assignment by a range exchange, without a single-partition window or a look at other rows.

``max(id) + row_number() over (order by k)`` would pull every new row into one task.  Instead the rows are
range-partitioned and sorted by the key, so a row's place is its partition's number and its place within
(``monotonically_increasing_id`` says both), and written once.  Then only the partitions' row counts, one number each,
are summed up, and each row adds the count of the partitions before its own.  Where Spark's sample puts the bounds of
the ranges makes no difference to the numbers.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelake.session import materialize

_IN_PARTITION = 33  # bits of monotonically_increasing_id that count rows within a partition


def ranked(rows: DataFrame, order: list, out: str, num_buckets: int | None = None, checkpoint: bool = True,
           key: str | None = None) -> DataFrame:
    """Adds ``out``: a row's rank from 0 in ``order``, whose columns together are unique.  ``key`` must not be null.

    The placed rows are written to the checkpoint folder, or with ``checkpoint=False`` kept by the executors: both hold
    on to one set of ranges, also where a lost part is worked out again.
    """
    ranged = rows.repartitionByRange(num_buckets, *order) if num_buckets else rows.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(placed) if checkpoint else placed.persist()
    part = F.shiftright("_place", _IN_PARTITION)
    parts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.count(key or F.lit(1)).alias("keys")) \
        .orderBy("_part").collect()  # one row per partition
    if any(r["n"] != r["keys"] for r in parts):
        raise ValueError(f"the key {key!r} is null in some rows")
    before = [0, *accumulate(r["n"] for r in parts)]
    inside = F.col("_place").bitwiseAND(F.lit((1 << _IN_PARTITION) - 1))
    if len(parts) <= 1:
        return placed.withColumn(out, inside).drop("_place")
    offsets = placed.sparkSession.createDataFrame(
        [(r["_part"], n) for r, n in zip(parts, before, strict=False)], "_part long, _off long")
    return (
        placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(out, F.col("_off") + inside).drop("_place", "_part", "_off")
    )


def assign_ids(new_rows: DataFrame, order_col: str | list[str], id_col: str, existing: DataFrame | None = None,
               existing_id_col: str | None = None, num_buckets: int | None = None,
               checkpoint: bool = True) -> DataFrame:
    """Give ``new_rows`` ids max(existing id) + 1, + 2, ... in order of the unique numeric ``order_col``.

    The key must be there and not null: without one the numbers would hang on how rows are partitioned.
    """
    key = order_col[0] if isinstance(order_col, list) else order_col
    if key not in new_rows.columns:
        raise ValueError(f"rows need the key {key!r} to be numbered by")
    rows = ranked(new_rows, [F.col(key)], "_rank", num_buckets, checkpoint, key)
    base = F.lit(1).cast("long")
    if existing is not None:
        base = F.coalesce(existing.select(F.max(existing_id_col or id_col)).scalar(), F.lit(0)).cast("long") + 1
    return rows.withColumn("_base", base).withColumn(id_col, F.col("_base") + F.col("_rank")).drop("_base", "_rank")
