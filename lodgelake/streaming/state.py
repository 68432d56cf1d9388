"""Command state as a base table and small files of changed rows.

``root/base/v{n}`` holds the state before batch n, sorted by key; ``root/changes/b{k}`` the rows that batch k changed.
The newest row of a key wins.  A batch reads only the rows that its commands name and writes only those that
it changes, so 100 commands on a table of any size write at most 100 rows.  When ``compact_every`` batches of changes
lie on a base, the next batch first writes a new base.

A version counts once it is listed, and it is listed once it is written: ``root/_versions/base=n`` names the batches
with changes on base n.  Batch k reads only what is listed below k and writes only its own files, so a batch
that ran half, or is run again after any later version, gives the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelake.operators import upkeep

END = 1 << 62


class CommandState:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key

    # -------------------------------------------------------------- versions
    def _names(self, folder: str) -> list[str] | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else None

    def version(self, before: int = END) -> tuple[int, list[int]] | None:
        """Number of the newest base up to ``before`` and the listed batches below ``before`` on it."""
        names = self._names(f"{self.root}/_versions")
        if names is None:
            return None
        bases = [n for n in (int(x.split("=")[1]) for x in names if x.startswith("base=")) if n <= before]
        if not bases:
            raise ValueError(f"the version list of {self.root} was emptied: the state is lost or the path is wrong")
        rows = self.spark.read.schema("batch_id long").parquet(f"{self.root}/_versions/base={max(bases)}")
        batches = sorted({r[0] for r in rows.where(F.col("batch_id") < before).collect()})  # at most compact_every
        return max(bases), [b for b in batches if b >= max(bases)]

    def _list(self, base: int, batch_id: int) -> None:
        self.spark.createDataFrame([(batch_id,)], "batch_id long").coalesce(1).write.mode("append") \
            .parquet(f"{self.root}/_versions/base={base}")

    def _write_base(self, state: DataFrame, number: int) -> None:
        state.select(*self.schema.fieldNames()).repartitionByRange(self.key).sortWithinPartitions(self.key) \
            .write.mode("overwrite").parquet(f"{self.root}/base/v{number:012d}")
        self._list(number, number - 1)

    def start(self, initial: DataFrame) -> None:
        """The first base, unless there is one."""
        if self.version() is None:
            self._write_base(initial, 0)

    def compact(self, before: int, least: int = 1) -> bool:
        """A new base of all before batch ``before`` if at least ``least`` batches of changes lie on the last one."""
        base, batches = self.version(before)
        if len(batches) < least:
            return False
        self._write_base(self.read(before), before)
        return True

    # -------------------------------------------------------------- reading
    def _base(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/base/v{number:012d}")

    def _latest(self, batches: list[int]) -> DataFrame:
        """The newest changed row of every key."""
        cols = self.schema.fieldNames()
        schema = T.StructType([*self.schema.fields, T.StructField("_batch", T.LongType())])
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/changes/b{b:012d}" for b in batches])
        return rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*cols), "_batch").alias("_r")) \
            .select(*[F.col(f"_r.{c}").alias(c) for c in cols])

    def read(self, before: int = END, keys: DataFrame | None = None) -> DataFrame:
        """The state before batch ``before``; of the rows with ``keys`` (one column, no nulls) only, if given."""
        found = self.version(before)
        if found is None:
            raise ValueError(f"no state under {self.root}")
        number, batches = found
        base = self._base(number)
        if keys is not None:
            lo, hi = keys.agg(F.min(keys.columns[0]), F.max(keys.columns[0])).first()
            base = base.where(F.col(self.key).between(lo, hi)) if lo is not None else base.where("false")
            keys = keys.toDF("_wanted").distinct()
            base = base.join(keys, base[self.key] == keys["_wanted"], "left_semi")
        if not batches:
            return base
        new = self._latest(batches)
        if keys is not None:
            new = new.join(keys, new[self.key] == keys["_wanted"], "left_semi")
        return base.join(new.select(self.key), self.key, "left_anti").unionByName(new)

    # -------------------------------------------------------------- writing
    def write_changes(self, batch_id: int, rows: DataFrame) -> None:
        """The new rows of batch ``batch_id``; at most one of each key."""
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]) \
            .withColumn("_batch", F.lit(batch_id).cast("long")).coalesce(1 + self.spark.sparkContext.defaultParallelism // 4) \
            .write.mode("overwrite").parquet(f"{self.root}/changes/b{batch_id:012d}")
        self._list(self.version(batch_id)[0], batch_id)

    def apply(self, batch_id: int, commands: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame],
              command_key: str | None = None, compact_every: int = 100, sums: bool = False) -> None:
        """Folds ``commands`` onto the rows they name and writes the rows that differ.  ``fold`` keeps columns that it does
        not know, so each row is compared with what it was and no second join is needed.  With ``sums`` what the change
        does to the sums per day and status (see upkeep) is written as well."""
        commands = commands.persist()  # read several times
        self.compact(batch_id, compact_every)
        keys = commands.select(command_key or self.key).where(F.col(command_key or self.key).isNotNull())
        old = self.read(batch_id, keys).persist()
        cols = self.schema.fieldNames()
        new = fold(old.withColumn("_was", F.struct(*cols)), commands).select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], "_was")
        changed = new.where(~F.struct(*cols).eqNullSafe(F.col("_was"))).select(*cols).distinct().persist()
        if sums:  # before the batch is listed, which makes both count
            before = old.join(changed.select(self.key), self.key, "left_semi")
            upkeep.day_status_deltas(before, changed).coalesce(1).write.mode("overwrite") \
                .parquet(f"{self.root}/sums/b{batch_id:012d}")
        self.write_changes(batch_id, changed)
        for df in (changed, old, commands):
            df.unpersist()

    def day_status_sums(self, before: int = END) -> DataFrame:
        """Bookings and revenue per day and status: those of the base and the changes since."""
        number, batches = self.version(before)
        parts = [upkeep.day_status_sums(self._base(number))]
        if batches:
            parts.append(self.spark.read.schema(parts[0].schema).parquet(
                *[f"{self.root}/sums/b{b:012d}" for b in batches]))
        return upkeep.added(*parts)
