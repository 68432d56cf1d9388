"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Size of a document: its words.  The budget (``share`` of all sizes) is dealt to the sources by weight.  A
source whose part exceeds ``epochs`` times its size is clamped there, and its excess is dealt again by
weight to the others until none is above its cap.  Of a source with target t and size n every document is
taken floor(t / n) times; the rest of t is met by one more copy of the first documents in a seeded hash
order, up to the one whose middle passes it.  So the words taken are within half a document of the target,
no document is taken more than ``epochs`` times, and reruns agree whatever the partitioning.

Up to ``most`` sources, one row of each reaches the driver and is broadcast.  Beyond that the sources stay a table:
the level up to which all are filled is found by rounds over it (two sums a round; a clamped source stays so, as
excess only raises the level), and documents meet their source by a shuffled join.  Both ways give the same rows.  The
running sum in hash order is cut into slices, so a source with a third of all rows is no single window.

Null text: size 0.  A null source is a source of its own, the last in order.  Repeated rows count each.
An empty table gives an empty result; a source without words has target 0.  Extra columns are left out.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelake.llm.common import cut, few_rows, pick, running_sum
from lodgelake.operators.ids import ranked

WORD = r"[^\x20\x09-\x0D]+"
MOST_SOURCES = 65536


def water_fill(sizes: list[int], weights: list[int], share: Fraction, epochs: int) -> list[Fraction]:
    """Targets by weight, none above epochs x size, the excess dealt again by weight."""
    left = share * sum(sizes)
    target = [Fraction(0)] * len(sizes)
    open_ = [i for i, n in enumerate(sizes)]
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] > total * epochs * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = Fraction(epochs * sizes[i])
        left -= sum(target[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return target


PLAN = "_pg string, source_size long, target double, _whole int, _rest double"


def driver_plan(rows: list, weights: tuple[int, ...], share: Fraction, epochs: int) -> list[tuple]:
    """Rows of PLAN from (source key, size) of few sources."""
    rows = sorted(rows, key=lambda r: (r[0] == "n", r[0]))  # by code point, null last
    target = water_fill([r[1] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, epochs)
    plan = []
    for (g, n), t in zip(rows, target, strict=True):
        whole = int(t // n) if n else 0
        plan.append((g, n, float(t), whole, float(t - whole * n)))
    return plan


def spark_plan(sizes: DataFrame, weights: tuple[int, ...], share: Fraction, epochs: int) -> DataFrame:
    """The same for any number of sources, in whole numbers of up to 38 digits."""
    def whole_number(x: int) -> Column:
        return F.lit(str(x)).cast("decimal(38,0)")

    placed = ranked(sizes.withColumn("_last", F.col("_g") == "n"), [F.col("_last"), F.col("_g")], "_i")
    place = F.col("_i") % len(weights)
    weight = F.lit(weights[0])
    for k, x in enumerate(weights[1:], 1):
        weight = F.when(place == k, F.lit(x)).otherwise(weight)
    placed = cut(placed.select("_g", F.col("n").cast("decimal(38,0)").alias("n"), weight.cast("decimal(38,0)").alias("w")))
    words, total = placed.agg(F.sum("n"), F.sum("w")).first()
    level, clamped = Fraction(share) * int(words) / int(total), -1
    while True:  # a source is full where level x weight is above its cap
        part, whole = whole_number(level.numerator) * F.col("w"), whole_number(level.denominator) * F.col("n")
        full = part > whole * epochs
        count, n, w = placed.where(full).agg(F.count(F.lit(1)), F.sum("n"), F.sum("w")).first()
        if count == clamped or w == total:
            break
        level, clamped = (Fraction(share) * int(words) - epochs * int(n or 0)) / (int(total) - int(w or 0)), count
    copies = F.when(F.col("n") > 0, F.expr("_part DIV _size")).otherwise(F.lit(0))
    parts = whole_number(level.denominator).cast("double")
    return placed.withColumn("_part", F.when(full, whole * epochs).otherwise(part)).withColumn("_size", whole) \
        .withColumn("_whole", copies.cast("int")).select(
            F.col("_g").alias("_pg"), F.col("n").cast("long").alias("source_size"),
            (F.col("_part").cast("double") / parts).alias("target"), "_whole",
            ((F.col("_part") - F.col("_whole") * F.col("_size")).cast("double") / parts).alias("_rest"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2),
                epochs: int = 2, seed: int = 17, most: int = MOST_SOURCES) -> DataFrame:
    """Documents' columns with size, source_size, target, taken (words) and copies (whole repetitions)."""
    spark = docs.sparkSession
    d = pick(docs).select(
        "*", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("_g"),
        F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed)))  # rows without an id are spread as well
        .otherwise(F.xxhash64("doc_id", F.lit(seed))).alias("_h"),
    )
    sizes = d.groupBy("_g").agg(F.sum("size").alias("n"))
    rows = few_rows(sizes, most)
    if rows is None:
        plan = spark_plan(sizes, weights, Fraction(share), epochs)
    else:
        plan = F.broadcast(spark.createDataFrame(  # one row per source, at most ``most``
            driver_plan(rows, weights, Fraction(share), epochs), PLAN))
    run = running_sum(d, "_g", "_h", ["doc_id", "size", F.xxhash64("text")], "size", "_before")
    more = (F.col("_rest") > 0) & (F.col("_before") + F.col("size") / 2 <= F.col("_rest"))
    return (
        run.join(plan, F.col("_g") == F.col("_pg"))
        .withColumn("copies", (F.col("_whole") + more.cast("int")).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_g", "_pg", "_h", "_before", "_whole", "_rest")
    )


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; see the module for nulls, ties and repeats."""
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document's row as many times as it is taken."""
    cols = pick(docs).columns
    return (mix_sources(docs).where("copies > 0")
            .withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*cols))
