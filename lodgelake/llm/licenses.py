"""License scans: exact set-similarity containment join of license notices with text blocks.

A template is a set of k words.  A block is a run of as many successive words of a text as the template has
words (fewer at the text's end).  A block matches when it holds at least the threshold's share of them, so o words:
every such block is found and reported (``blocks``).  A match gives its label when the block also holds all words of
the template that name the license (NAMES), so that a notice of another license, which shares the other words, is
reported but not labelled.
The join is exact:

* token order: the templates' words by their count over all documents, rarest first;
* prefix filter: a matching block holds one of the template's first k - o + 1 words in that order, so
  only texts with such a word, and only blocks around it, are looked at;
* length filter: a text of fewer than o words can't match;
* positional filter: a block is tried only where it reaches a prefix word, and first only where it starts at a word
  of the template, as any matching block can be moved right to its first such word and still matches; the blocks
  that can be moved to a match are tried after it.

The templates are a parameter, so their words' counts are bounded (one row per word reaches the driver).
All steps are built-in functions; there is no shuffle but that of the word counts.

Base phrases are found as successive words and their labels always stay.  ``score`` is 1 with a base phrase,
else the largest share of a template's words in a block that gives its label, else 0.  ``block_labels`` and
``block_score`` are those of all matching blocks, named or not, without the base phrases.

Null or empty text: no words, no label, score 0.  Repeated rows count each.  An empty table gives an empty
result.  Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelake.llm.common import pick

# fixed values: phrases that name a license
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# fixed values: notices by label
TEMPLATES = {
    "mit": ["released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files"],
    "apache": ["licensed under the apache license version 2 0"],
    "gpl": ["this work is licensed under the gnu general public license version 3",
            "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "cc": ["licensed under cc by nc 4 0", "licensed under cc by sa 4 0"],
    "mpl": ["subject to the terms of the mozilla public license v 2 0"],
    "proprietary": ["all rights reserved no part of this may be reproduced"],
}

# fixed values: words without which a block is another license's; those of them that a template holds are needed
NAMES = {
    "mit": "mit",
    "apache": "apache",
    "gpl": "gnu general public",
    "cc": "cc",
    "mpl": "mozilla",
    "proprietary": "no",
}

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, GAP), "")


def strings(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by its words' count over all documents, rarest first."""
    counts = {r[0]: r[1] for r in docs.select(F.explode("_words").alias("w")).where(F.col("w").isin(vocabulary))
              .groupBy("w").count().collect()}  # one row per word of the templates
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def least_held(k: int, threshold: float) -> int:
    """The smallest n with n / k >= threshold; the ceiling of a product may round to one more."""
    return sum(n / k < threshold for n in range(k + 1))


def matching_blocks(template: str, order: list[str], threshold: float, names: str = "") -> Column:
    """(start, held, named) of every block that holds the threshold's share of the template's words, by start; null or
    empty without one.  ``held``: how many of them; ``named``: whether it holds all that are in ``names``."""
    length = len(template.split())
    tokens = sorted(set(template.split()), key=order.index)
    k = len(tokens)
    need = least_held(k, threshold)
    named = [w for w in tokens if w in names.split()]
    prefix, all_ = strings(tokens[:k - need + 1]), strings(tokens)
    n = F.size("_words")

    def block(p: Column) -> Column:
        return F.slice("_words", p + 1, length)

    def held(p: Column) -> Column:
        return F.size(F.array_intersect(block(p), all_))

    def around(at: Column, inner) -> Column:
        """The distinct starts of blocks that reach the positions."""
        return F.array_distinct(F.flatten(F.transform(at, lambda q: inner(
            F.sequence(F.greatest(q - length + 1, F.lit(0)), q)))))

    reach = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(prefix, F.get("_words", i)))
    starts = around(reach, lambda ps: F.filter(ps, lambda p: F.array_contains(all_, F.get("_words", p))))
    every = around(F.filter(starts, lambda p: held(p) >= need), lambda ps: ps)
    has_names = (lambda p: F.size(F.array_intersect(block(p), strings(named))) == len(named)) if named \
        else (lambda p: F.lit(True))
    found = F.filter(F.transform(every, lambda p: F.struct(
        p.cast("long").alias("start"), held(p).alias("held"), has_names(p).alias("named"))), lambda b: b["held"] >= need)
    return F.when((n >= need) & F.arrays_overlap("_words", prefix), F.array_sort(found))


def base_places() -> Column:
    """(start, label) of every base phrase, in order of the text's words."""
    def hit(i: Column) -> Column:
        out = F.lit(None).cast("struct<start:bigint,label:string>")
        for phrase, label in BASE.items():
            w = phrase.split()
            same = F.lit(True)
            for back, x in enumerate(reversed(w)):
                same = same & (F.get("_words", i - back) == x)
            out = F.when(same, F.struct((i - len(w) + 1).cast("long").alias("start"), F.lit(label).alias("label"))) \
                .otherwise(out)
        return out

    ends = sorted({p.split()[-1] for p in BASE})
    at = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.get("_words", i).isin(ends))
    found = F.filter(F.transform(at, hit), lambda x: x.isNotNull())
    return F.when(F.arrays_overlap("_words", strings(ends)), found)


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.8,
                 naming: dict[str, str] = NAMES) -> DataFrame:
    """Documents' columns with n_words, base places, base_labels, labels, score and ``blocks``: (label, template's
    number in its label, start, share, named) of every block over the threshold."""
    templates = templates or TEMPLATES
    d = pick(docs).withColumn("_words", words(F.col("text")))
    order = token_order(d, sorted({w for ts in templates.values() for t in ts for w in t.split()}))
    found = [(label, i, len(set(t.split())), matching_blocks(t, order, threshold, naming.get(label, "")))
             for label, ts in templates.items() for i, t in enumerate(ts)]  # a label without names has its threshold only

    def told(label: str, i: int, k: int, c: str) -> Column:
        return F.coalesce(F.transform(c, lambda b: F.struct(
            F.lit(label).alias("label"), F.lit(i).alias("template"), b["start"].alias("start"),
            (b["held"] / F.lit(float(k))).alias("share"), b["named"].alias("named"))), F.array())

    d = d.withColumn("_base", base_places()).withColumns({f"_t{j}": c for j, (*_, c) in enumerate(found)})
    d = d.withColumn("blocks", F.concat(*[told(label, i, k, f"_t{j}") for j, (label, i, k, _) in enumerate(found)]))
    starts = F.transform("_base", lambda x: x["start"])
    base = F.coalesce(F.array_sort(F.array_distinct(F.transform("_base", lambda x: x["label"]))),
                      F.array().cast("array<string>"))
    own = F.filter("blocks", lambda b: b["named"])
    n_base = F.coalesce(F.size("_base"), F.lit(0)).cast("long")
    return d.select(
        *pick(docs).columns, F.size("_words").cast("long").alias("n_words"),
        F.when(F.col("_base").isNull(), F.lit(0)).otherwise(n_base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, own["label"]))).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(own["share"]), F.lit(0.0))).alias("score"),
        "blocks",
    )


def op5(docs: DataFrame) -> DataFrame:
    """One row a document with its base places and all labels, and the number, labels and largest share of its
    matching blocks, named or not; see the module for nulls and empty texts."""
    return license_scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("blocks").cast("long").alias("n_blocks"),
        F.concat_ws(",", F.array_sort(F.array_distinct("blocks.label"))).alias("block_labels"),
        F.coalesce(F.array_max("blocks.share"), F.lit(0.0)).alias("block_score"))
