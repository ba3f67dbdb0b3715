"""Whole-table checks on the smallest driver tables against SQL and by counts."""

import pytest
from pyspark.sql import functions as F

from wordloom.operators.normalize import tokenize
from wordloom.plans import inputs
from wordloom.plans.oracle import oracle_sql
from wordloom.plans.queries import registry

from conftest import SMALL_SF


@pytest.mark.parametrize("name", ["preprocess_documents", "normalization_stats"])
def test_whole_table_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL_SF}/{table}.parquet'")
    expected = con.sql(oracle_sql()[name]).df()
    got = registry()[name](spark, SMALL_SF).toPandas()
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).values.tolist()))
    assert rows(got) == rows(expected)


def test_token_count_preserved(spark, normalizer):
    comments = inputs.comments(spark, SMALL_SF)
    toks = tokenize(comments, "text")
    ann = normalizer.annotate(toks)
    assert toks.count() == ann.count()
    assert ann.filter(F.col("out_word").isNull()).count() == 0
