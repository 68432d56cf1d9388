"""Tables whose files were written under several versions of their schema.

``root/generation=n`` holds the files of one version.  Each is read by the schema that its own files carry and brought to
the table's declared one: a column that a version had not yet gets its declared default, a type that was widened since is
cast, a renamed column is found by its old name, and a column dropped since is not read.  What can't be had
without loss (a narrower declared type, a text read as a number) is an error, not a guess.  Filters and column choice
reach each version's scan, as the versions are a plain union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelake import schema as S

_WHOLE = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}  # digits that fit


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether every value of ``old`` is one of ``new``."""
    a, b = old.simpleString(), new.simpleString()
    if a == b or isinstance(old, T.NullType):
        return True
    if a in _WHOLE and b in _WHOLE:
        return _WHOLE[a] <= _WHOLE[b]
    if isinstance(new, T.DecimalType):
        if isinstance(old, T.DecimalType):
            return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
        return a in _WHOLE and new.precision - new.scale >= _WHOLE[a]
    if b == "double":
        return a in ("float", "tinyint", "smallint", "int")
    return (a, b) == ("date", "timestamp_ntz")


def write_generation(df: DataFrame, root: str, generation: int, mode: str = "append") -> None:
    df.write.mode(mode).parquet(f"{root.rstrip('/')}/generation={generation}")


def generations(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("generation="))


def upgraded(df: DataFrame, table: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """Rows of an old version with the declared columns of ``table``; ``renamed``: declared name -> old name."""
    have = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for c in S.spec(table):
        declared = S.struct_type(table)[c.name].dataType
        old = c.name if c.name in have else (renamed or {}).get(c.name)
        if old in have:
            if not widens(have[old], declared):
                raise ValueError(f"{table}.{c.name}: {have[old].simpleString()} files can't be read as {declared.simpleString()}")
            columns.append(F.col(old).cast(declared).alias(c.name))
        else:
            default = F.expr(c.default) if c.default is not None else F.lit(None)
            columns.append(default.cast(declared).alias(c.name))
    return df.select(*columns)


def load_generations(spark: SparkSession, root: str, table: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """All versions under ``root`` as one table of the declared schema."""
    found = generations(spark, root)
    if not found:
        return spark.createDataFrame([], S.struct_type(table))
    parts = [upgraded(spark.read.parquet(f"{root.rstrip('/')}/generation={g}"), table, renamed) for g in found]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
