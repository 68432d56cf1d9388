"""Bookings stored by month, of which a change rewrites only the months it touches.

``root/data/version=n/booking_month=m`` holds a month as version n left it; ``root/versions/v{n}`` lists which version
of each month counts.  A change finds the months of the rows it names by a semi-join over the ids and directory names
(no other column is read), writes these months anew as version n + 1 and then lists them: the files of the other
months stay as they are, readers of version n are not disturbed, and a version that was not listed never counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelake import schema as S
from lodgelake.functions.columns import month_key
from lodgelake.sources.sinks import conform

_LIST = "booking_month string, version int"


class MonthTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = S.struct_type("bookings")

    def version(self) -> int | None:
        """The newest listed version."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        done = [s.getPath().getName() for s in fs.listStatus(path)
                if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(x[1:]) for x in done), default=None)

    def months(self, version: int | None = None) -> dict[str, int]:
        """Month -> the version whose files hold it: a few hundred rows."""
        version = self.version() if version is None else version
        if version is None:
            raise ValueError(f"no bookings under {self.root}")
        return dict(self.spark.read.schema(_LIST).parquet(f"{self.root}/versions/v{version}").collect())

    def read(self, version: int | None = None) -> DataFrame:
        """Bookings with ``booking_month``; filters on it prune directories."""
        months = self.months(version)
        schema = T.StructType([*self.schema.fields, T.StructField("booking_month", T.StringType())])
        if not months:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/data/version={v}/booking_month={m}" for m, v in sorted(months.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data/").parquet(*paths) \
            .select(*schema.fieldNames())

    def _write(self, bookings: DataFrame, version: int, kept: dict[str, int]) -> None:
        data = f"{self.root}/data/version={version}"
        rows = conform(bookings, "bookings").withColumn("booking_month", F.coalesce(month_key("booking_date"), F.lit("none")))
        # a hot month is dealt to many tasks
        rows.repartitionByRange("booking_month", "hotel_id", "booking_id") \
            .sortWithinPartitions("booking_month", "hotel_id", "booking_id") \
            .write.mode("overwrite").partitionBy("booking_month").parquet(data)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(data)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        new = [s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(path) if s.isDirectory() and "=" in s.getPath().getName()]
        listed = sorted({**kept, **dict.fromkeys(new, version)}.items())
        self.spark.createDataFrame(listed, _LIST).coalesce(1).write.mode("overwrite") \
            .parquet(f"{self.root}/versions/v{version}")

    def write(self, bookings: DataFrame) -> None:
        """The first version: all months."""
        if self.version() is not None:
            raise ValueError(f"{self.root} holds bookings already: use replace")
        self._write(bookings, 0, {})

    def replace(self, edits: DataFrame | None = None, gone: DataFrame | None = None) -> list[str]:
        """Puts the rows ``edits`` in place of those with the same booking_id (new ids are added) and drops the ids
        ``gone``.  Gives the months rewritten; without any there is no new version."""
        now = self.version()
        months = self.months(now)
        stored = self.read(now)
        ids = [d.select("booking_id") for d in (edits, gone) if d is not None]
        ids = (ids[0].unionByName(ids[1]) if len(ids) > 1 else ids[0]).where("booking_id IS NOT NULL").distinct()
        touched = {r[0] for r in stored.join(ids, "booking_id", "left_semi").select("booking_month").distinct().collect()}
        if edits is not None:
            key = F.coalesce(month_key("booking_date"), F.lit("none"))
            touched |= {r[0] for r in edits.select(key.alias("m")).distinct().collect()}
        if not touched:
            return []
        rest = stored.where(F.col("booking_month").isin(sorted(touched))).join(ids, "booking_id", "left_anti") \
            .select(*self.schema.fieldNames())
        rows = rest if edits is None else rest.unionByName(conform(edits, "bookings"))
        self._write(rows, now + 1, {m: v for m, v in months.items() if m not in touched})
        return sorted(touched)

    def delete_hotels(self, hotels: DataFrame) -> list[str]:
        """Drops the bookings of these hotels."""
        stored = self.read()
        return self.replace(gone=stored.join(hotels.select("hotel_id").distinct(), "hotel_id", "left_semi").select("booking_id"))
