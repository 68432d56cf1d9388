"""The registered queries of this folder: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodgelake.llm import (audit, classifier, embeddings, licenses, minhash, mixing, packing, ppm, quality, repeats,
                           sharding, spelling, toxicity)
from lodgelake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(table(spark, sf_dir, name))

    run.__doc__ = operator.__doc__
    return run


def _on_labelled(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

    run.__doc__ = operator.__doc__
    return run


QUERIES: dict[str, Query] = {
    "op1_embedding_dedup": _on("embeddings", embeddings.op1),
    "op2_mixing": _on("documents", mixing.op2),
    "op3_minhash_dedup": _on("documents", minhash.op3),
    "op4_lm_scoring": _on("documents", ppm.op4),
    "op5_license_scan": _on("documents", licenses.op5),
    "op6_quality_rules": _on("documents", quality.op6),
    "op7_suffix_dedup": _on("documents", repeats.op7),
    "op8_quality_classifier": _on_labelled(classifier.op8),
    "op9_packing": _on("documents", packing.op9),
    "op10_sharding": _on("documents", sharding.op10),
    "op11_toxicity": _on_labelled(toxicity.op11),
    "op12_filter_audit": _on_labelled(audit.op12),
    "op13_spelling_variants": _on("documents", spelling.op13),
}

ORACLE: dict[str, str] = {"op12_filter_audit": audit.SQL}
