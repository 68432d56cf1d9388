"""Filter interaction audit: every order of the filters, enumerated by a recursive CTE.

One pass over the texts gives each document a mask: one bit for each of the five filters it fails.  Documents are
added up to cells (part, mask, labels), at most 2^5 x 4 a part, and from there on no row stands for a document.
A recursive CTE starts from the masks that occur, each with the empty prefix, and extends every prefix by the
letters not yet in it; a row carries the applied bits, so at each level it knows whether documents of its mask are
kept, removed or already gone.  Joined with the cells these are the step's counts; a prefix of k letters
stands for (5 - k)! of the 120 orders, and each order takes the counts of its prefixes.  Recursion and join
are of a size set by the filters and the number of parts, whatever the number of documents.

Identity of texts (E) is that of their SHA-256.  Equal texts have the same mask but for E, so texts never travel:
rows of one text are added up by (hash, part, labels) before a window looks for the smallest doc_id, and a text with
millions of copies is a few rows.

Null text: empty; null and empty texts are identical.  Null lang: the empty string.  Rows with the smallest doc_id of
a text don't fail E, however often they occur.  A null doc_id is not smaller than any; it fails E if its text has a
doc_id, and has no label.  Several labels of one document: the largest counts.  An empty table gives no part, so an
empty result.  Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelake.llm.common import cut, pick

LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
_SPACES = "\t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_RECURSION = """
WITH RECURSIVE steps(filter_order, applied, step, mask, bit) AS (
  SELECT CAST('' AS STRING), 0, 0, mask, 0 FROM (SELECT DISTINCT mask FROM {cells})
  UNION ALL
  SELECT s.filter_order || l.letter, s.applied | l.bit, s.step + 1, s.mask, l.bit
  FROM steps s LATERAL VIEW inline(filter({letters}, x -> s.applied & x.bit = 0)) l AS letter, bit
)
SELECT filter_order, step, bit, mask,
  mask & applied = 0 AS keeps, mask & applied = bit AND mask & bit <> 0 AS removes,
  mask & bit <> 0 AND mask & applied <> bit AS repeats, mask = bit AS alone
FROM steps WHERE step > 0"""


def _with_failures(d: DataFrame) -> DataFrame:
    """``mask``: the bits of the filters A to D that the (non-null) text fails."""
    text, n, size = F.col("text"), F.col("_words"), F.char_length("text")
    d = d.withColumn("_words", F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), ""))
    d = d.withColumn("_distinct", F.size(F.array_distinct(n))).withColumn("_words", F.size(n))
    fails = [
        n < MIN_WORDS,
        100 * F.col("_distinct") < DISTINCT_PERCENT * n,
        100 * (size - F.char_length(F.translate(text, _CAPITALS, ""))) > CAPITAL_PERCENT * size,
        text.rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return d.withColumn("mask", mask).drop("_words", "_distinct")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part by the filters they fail and their labels."""
    d = pick(docs, {"doc_id": "bigint", "text": "string", "lang": "string"}) \
        .select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = _with_failures(d).withColumn("_hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    d = d.groupBy("doc_id", "part", "_hash", "mask").agg(F.count(F.lit(1)).alias("_n"))
    lab = pick(labels, {"doc_id": "bigint", "quality": "int", "toxic": "int"}).where("doc_id IS NOT NULL") \
        .groupBy("doc_id").agg((F.max("quality") == 1).alias("_good"), (F.max("toxic") == 1).alias("_toxic"))
    d = d.join(lab, "doc_id", "left").select("doc_id", "part", "_hash", "mask", "_n", *[
        F.coalesce(f"_{c}", F.lit(False)).alias(c) for c in ("good", "toxic")])
    # of each text: its rows by part and labels; only those of the smallest id are free of E
    text = Window.partitionBy("_hash")
    d = d.groupBy("_hash", "part", "mask", "good", "toxic").agg(
        F.sum("_n").alias("_n"), F.min("doc_id").alias("_least"), F.min_by("_n", "doc_id").alias("_own"))
    least = F.min("_least").over(text)
    free = F.when(least.isNull(), F.col("_n")).when(F.col("_least") == least, F.col("_own")).otherwise(0)
    d = d.withColumn("_free", free).select("part", "good", "toxic", F.inline(F.array(
        F.struct("mask", F.col("_free").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("_n") - F.col("_free")).alias("n")))))
    return d.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def interactions(cells: DataFrame) -> DataFrame:
    """Of each part and order of the filters, what each step keeps and removes."""
    cells = cut(cells)  # at most 2^5 x 4 rows a part; read by every level of the recursion
    spark = cells.sparkSession
    letters = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(LETTERS))
    steps = spark.sql(_RECURSION.replace("{letters}", f"array({letters})"), cells=cells)
    when = lambda c, *also: F.sum(F.when(F.expr(" AND ".join((c, *also))), F.col("n")).otherwise(0))
    # the recursion has at most 325 prefixes x 32 masks
    emitted = cells.join(F.broadcast(steps), "mask").groupBy("part", "filter_order").agg(
        when("keeps").alias("kept"), when("removes").alias("removed"), when("repeats").alias("redundant"),
        when("alone").alias("unique_fails"), when("removes", "good").alias("good_lost"),
        when("removes", "toxic").alias("toxic_lost"))
    prefix = emitted.withColumnRenamed("filter_order", "_prefix")
    orders = emitted.where(F.length("filter_order") == len(LETTERS)).select(
        "part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    orders = orders.withColumn("_prefix", F.expr("left(filter_order, step)"))
    letter = Window.partitionBy("part", F.expr("right(_prefix, 1)"))  # one row for each order
    return orders.join(prefix, ["part", "_prefix"]).withColumn("shapley", F.sum("removed").over(letter)).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Part, filter_order, step and the step's counts; see the module for nulls, empty texts and repeats."""
    return interactions(cells(docs, labels))


#: the same by another way: DuckDB enumerates the orders over the documents' masks
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
lab AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(q = 1, false) AS good, coalesce(t = 1, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * len(d.text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN first_id IS NOT NULL AND (d.doc_id IS NULL OR d.doc_id > first_id) THEN 16 ELSE 0 END) AS mask
  FROM d JOIN least ON d.text = least.text LEFT JOIN lab ON d.doc_id = lab.doc_id
), c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
s(filter_order, applied, bit, before) AS (
  SELECT '', 0, 0, 0
  UNION ALL
  SELECT s.filter_order || f.letter, s.applied | f.bit, f.bit, s.applied FROM s JOIN f ON s.applied & f.bit = 0
), e AS (
  SELECT part, filter_order, length(filter_order) AS step, right(filter_order, 1) AS letter,
    sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM s CROSS JOIN c WHERE filter_order <> '' GROUP BY part, filter_order, applied, bit, before
)
SELECT e.part, o.filter_order, CAST(e.step AS INTEGER) AS step, CAST(e.kept AS BIGINT) AS kept,
  CAST(e.removed AS BIGINT) AS removed, CAST(e.redundant AS BIGINT) AS redundant,
  CAST(e.unique_fails AS BIGINT) AS unique_fails, CAST(e.good_lost AS BIGINT) AS good_lost,
  CAST(e.toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(e.removed) OVER (PARTITION BY e.part, e.letter) AS BIGINT) AS shapley
FROM e JOIN (SELECT filter_order FROM s WHERE length(filter_order) = 5) o ON starts_with(o.filter_order, e.filter_order)
"""
