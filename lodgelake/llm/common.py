"""Shared helpers: column choice, lineage cuts, running sums, word spans in Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodgelake.session import checkpoint_dir

DOCUMENT = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}

#: bytes of text that one numpy pass holds at a time; a longer document is a pass of its own
PASS_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python finds it."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    packed = Path(tempfile.mkdtemp(prefix="lodgelake-")) / "lodgelake.zip"  # the driver's copy; Spark hands it out
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(packed))
    _SHIPPED.add(spark.sparkContext.applicationId)


def pick(df: DataFrame, cols: dict[str, str] | None = None) -> DataFrame:
    """Exactly the named columns with their types; a missing one is null, any other column is left out.

    The match is by exact spelling and position, so extra columns may clash in any way.
    """
    cols = cols or DOCUMENT
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return flat.select(*[
        (F.col(f"_c{names.index(c)}") if c in names else F.lit(None)).cast(t).alias(c) for c, t in cols.items()
    ])


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few_rows(df: DataFrame, most: int) -> list | None:
    """Rows of a dimension for the driver where there are at most ``most``; None where there are more, which then
    stay distributed."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


RUN_BUCKETS = 1024


def running_sum(df: DataFrame, group: str, spread: str, ties: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``group`` before this one.

    Rows of a group stand in order of the hash column ``spread`` (a bigint over its whole range), then
    ``ties``; rows equal in all of these are interchangeable.  A group is cut into RUN_BUCKETS slices by
    the hash's high bits: one window per slice, one over the at most RUN_BUCKETS slice totals.  So a hot
    group is spread over many tasks.  ``group`` must not be null.
    """
    sliced = df.withColumn("_slice", F.shiftright(spread, 64 - RUN_BUCKETS.bit_length() + 1).cast("int"))
    before = (
        sliced.groupBy(group, "_slice").agg(F.sum(value).alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(
            Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col(group).alias("_bg"), F.col("_slice").alias("_bs"), "_base")
    )
    w = Window.partitionBy(group, "_slice").orderBy(spread, *ties).rowsBetween(Window.unboundedPreceding, -1)
    inner = sliced.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    return (
        inner.join(before, (F.col(group) == F.col("_bg")) & (F.col("_slice") == F.col("_bs")))
        .withColumn(out, (F.col(out) + F.col("_base")).cast("bigint"))
        .drop("_slice", "_bg", "_bs", "_base")
    )


# ---------------------------------------------------------------- text as bytes

def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def release() -> None:
    """Gives memory that arrays no longer use back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def passes(off: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes together, or one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j
    release()


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def spans(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word: a run of bytes outside ``gap`` within one document."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    lo = off[:-1][off[:-1] < off[1:]]
    first[lo] = inside[lo]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    hi = off[1:][off[:-1] < off[1:]] - 1
    last[hi] = inside[hi]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which for numbers is several times faster than np.unique's hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


_BASE = 0x5851F42D4C957F2D
_CODE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        a = np.full(max(n, PASS_BYTES + 1), base, np.uint64)
        a[0] = 1
        _POWERS[name] = have = np.cumprod(a)
    return have[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[data] * _powers("up", _BASE, n), out=total[1:])
    back = _powers("down", pow(_BASE, -1, 1 << 64), n + 1)
    return mix((total[end] - total[start]) * back[start])


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k successive words of one document, and for each the index of its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:n].copy()
    for i in range(1, k):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[i:i + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1:k - 1 + n])
    return mix(g[at]), at
