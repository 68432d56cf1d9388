"""Connected components of a table of links, without a window or a group that holds a hot vertex."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelake.llm.common import cut

#: links that one task joins in the end: a bound on its memory; more are contracted first
LAST_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the links and the smallest vertex each is joined with."""
    v, x = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = x[:len(a)], x[len(a):]
    root = np.arange(len(v))
    while True:  # hook the larger root of each link on the smaller, then flatten
        rx, ry = root[x], root[y]
        open_ = rx != ry
        if not open_.any():
            return v, v[root]
        x, y = x[open_], y[open_]
        lo, hi = np.minimum(rx, ry)[open_], np.maximum(rx, ry)[open_]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column("a").to_numpy()])
        b = np.concatenate([b, batch.column("b").to_numpy()])
        if len(a) > 4 * LAST_LINKS:
            a, b = forest(a, b)
    v, root = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], ["a", "b"])


def components(links: DataFrame, last_links: int = LAST_LINKS) -> DataFrame:
    """(id, component): for each vertex of ``links`` (a, b bigint, not null) the smallest one it is joined with.

    Each task first replaces its links by a forest.  While more than ``last_links`` are left, every vertex is
    merged with the neighbour, or itself, that comes first in an order drawn anew each round; a constant part
    of the vertices goes each time, whatever the graph.  The last links are joined by one task of bounded size.
    """
    e = cut(links.select("a", "b").where("a <> b").mapInArrow(_joined, "a bigint, b bigint").where("a <> b"))
    merged = None  # vertex -> the vertex it has become
    salt = 0
    while e.count() > last_links:
        salt += 1
        both = e.union(e.select("b", "a")).toDF("v", "w")
        both = both.union(both.select("v", "v").distinct())
        to = cut(both.groupBy("v").agg(F.min_by("w", F.struct(F.xxhash64("w", F.lit(salt)), "w")).alias("to")))
        x, y = to.toDF("a", "ta"), to.toDF("b", "tb")
        e = cut(e.join(x, "a").join(y, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b")
                .distinct().mapInArrow(_joined, "a bigint, b bigint").where("a <> b"))
        merged = to.toDF("id", "to") if merged is None else cut(
            merged.join(to.withColumnRenamed("to", "next"), merged["to"] == to["v"], "left")
            .select("id", F.coalesce("next", "to").alias("to")))
    last = e.repartition(1).mapInArrow(_joined, "a bigint, b bigint").toDF("id", "component")
    if merged is None:
        return last.union(last.select("component", "component")).distinct()
    ends = merged.join(last.toDF("to", "root"), "to", "left").select("id", F.coalesce("root", "to").alias("root"))
    least = ends.groupBy("root").agg(F.min("id").alias("component"))
    return ends.join(least, "root").select("id", "component")
