"""Typed table scans (Parquet, JDBC) and the driver's raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodgelake import schema as S

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Parquet carries its own schema, so nothing is inferred."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: declared schemas of driver tables that are read by name and type
DECLARED = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz",
}


def load_declared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table read with its declared schema: no inference, no column beyond those declared."""
    return spark.read.schema(DECLARED[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A domain table stored as Parquet under ``root/name`` with its declared schema.

    The declared schema is applied at the scan (no inference pass) and
    columns listed in ``schema.DROPPED_COLUMNS`` never enter the plan.
    """
    return spark.read.schema(S.struct_type(name)).parquet(f"{root.rstrip('/')}/{name}")


def load_jdbc(
    spark: SparkSession,
    url: str,
    name: str,
    partition_column: str,
    lower_bound: int,
    upper_bound: int,
    num_partitions: int,
    properties: dict | None = None,
) -> DataFrame:
    """A live relational table read in ``num_partitions`` parallel key ranges.

    Only the declared columns are selected, so credentials columns are never
    read; each partition issues its own range query on the primary key.
    """
    cols = ", ".join(f.name for f in S.struct_type(name).fields)
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", f"(SELECT {cols} FROM {name}) AS t")
        .option("partitionColumn", partition_column)
        .option("lowerBound", str(lower_bound))
        .option("upperBound", str(upper_bound))
        .option("numPartitions", str(num_partitions))
        .option("fetchsize", "10000")
    )
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    df = reader.load()
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in S.struct_type(name).fields])
