"""The registered queries themselves on empty tables and on tables with more columns."""

import pytest

import corpus_pipeline
from cellweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ALL = {**QUERIES, "pipeline": corpus_pipeline.run}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A few rows each with null columns, beside columns whose names the operators use themselves."""
    folder = tmp_path_factory.mktemp("small")
    more = ["'x' as n", "'x' as size", "1 as payload", "'x' as digest", "'x' as th", "'x' as shard", "'x' as b", "'x' as block", "'x' as v", "1 as score", "'x' as n_tokens", "'x' as kept"]
    for name, key in (("documents", "doc_id"), ("embeddings", "vec_id"), ("pages", "page_id"), ("benchmark", "item_id"), ("labels", "doc_id"), ("conversations", "conv_id")):
        df = spark.read.parquet(f"{SF}/{name}.parquet").where(f"{key} < 60")
        nulls = df.limit(2).selectExpr(*[f"cast(null as {t}) as {c}" for c, t in df.dtypes])
        df.unionByName(nulls).unionByName(df.where(f"{key} = 5")).selectExpr("*", *more).write.parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


@pytest.mark.parametrize("name", list(ALL))
def test_empty_tables(spark, empty, name):
    out = ALL[name](spark, empty)
    assert out.count() == (name == "op11_chat_format")  # its own conversation
    assert out.schema.simpleString() == ALL[name](spark, SF).schema.simpleString()


@pytest.mark.parametrize("name", list(ALL))
def test_more_columns_nulls_and_repeated_rows(spark, small, name):
    rows = ALL[name](spark, small).collect()
    table = {"op8_warc": "pages"}.get(name, "documents")
    assert rows and (name in ("op6_topk", "op11_chat_format", "op12_lexical_search", "op13_filter_audit", "pipeline") or len(rows) == spark.read.parquet(f"{small}/{table}.parquet").count() > 50)


def test_sql_of_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
