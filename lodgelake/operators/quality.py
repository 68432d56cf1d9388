"""DQ1-DQ4: the constraints the relational store enforced, as data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelake import schema as S
from lodgelake.functions.columns import store_text


def constraint_violations(df: DataFrame, table: str) -> DataFrame:
    """One row per (record, violated rule): NOT NULL, maximum length, value domain.

    All rules are evaluated in one pass into an array of violations that is
    then exploded -- a single scan, not a union of one filter per rule.
    """
    keys = S.PRIMARY_KEYS[table]
    checks = []
    for c in S.spec(table):
        if c.name not in df.columns:
            continue
        v = F.col(c.name)
        if not c.nullable:
            checks.append(F.when(v.isNull(), F.struct(F.lit(c.name).alias("column"), F.lit("null").alias("rule"))))
        if c.max_len:
            checks.append(F.when(F.length(v) > c.max_len, F.struct(
                F.lit(c.name).alias("column"), F.lit(f"longer than {c.max_len}").alias("rule"))))
        if c.domain:
            checks.append(F.when(v.isNotNull() & ~v.isin(*c.domain), F.struct(
                F.lit(c.name).alias("column"), F.lit("outside domain").alias("rule"))))
    if not checks:
        return df.select(*keys).limit(0).withColumn("column", F.lit("")).withColumn("rule", F.lit(""))
    found = F.array_compact(F.array(*checks))
    return df.select(*keys, F.explode(found).alias("_v")).select(*keys, "_v.column", "_v.rule")


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """DQ1 over several tables at once: (table_name, record_key, column, rule) rows, one scan per table."""
    parts = []
    for name, df in tables.items():
        keys = S.PRIMARY_KEYS[name]
        v = constraint_violations(df, name)
        parts.append(v.select(F.lit(name).alias("table_name"),
                              F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("record_key"),
                              "column", "rule"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_keys(df: DataFrame, cols: list[str], case_insensitive: bool = True) -> DataFrame:
    """Key values held by more than one row (UNIQUE / PRIMARY KEY violations).

    By default text is compared as the store does, whatever the case and accents, and the smallest lower-case spelling
    is shown."""
    if not case_insensitive:
        return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    text = {c: F.col(c).cast("string") for c in cols}
    keys = [store_text(t).alias(f"_k{i}") for i, t in enumerate(text.values())]
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.min(F.lower(t)).alias(c) for c, t in text.items()])
            .filter(F.col("rows") > 1).select(*cols, "rows"))


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None) -> DataFrame:
    """Child rows whose non-null foreign key has no parent row."""
    p = parent.select(F.col(pk or fk).alias(fk)).distinct()
    return child.filter(F.col(fk).isNotNull()).join(p, fk, "left_anti")


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill declared defaults into NULLs; add absent declared columns (typed) with their default."""
    out = df
    for c in S.spec(table):
        default = F.expr(c.default).cast(c.dtype) if c.default is not None else F.lit(None).cast(c.dtype)
        if c.name in df.columns:
            if c.default is not None:
                out = out.withColumn(c.name, F.coalesce(F.col(c.name), default))
        else:
            out = out.withColumn(c.name, default)
    return out
