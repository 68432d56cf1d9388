import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source), with extra columns that clash with results' names."""
    from lodgelake.llm.common import ship

    ship(spark)

    def build(rows, extra=True):
        full = [(r[0], r[1], *(r[2:] or ("en", "a"))) for r in rows]
        df = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in full], COLUMNS)
        if extra:
            df = df.selectExpr("*", "'x' AS kept", "'x' AS size", "'x' AS score", "1 AS _chunk", "2 AS _g",
                               "'x' AS n_words", "'x' AS component_id", "'x' AS shard", "'x' AS labels")
        return df.repartition(3)

    return build
