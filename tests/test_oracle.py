"""Every query of the catalogue that has SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from curaspark.plans import catalogue

DATA = "/root/testdata/sf0.001"


def norm(rows):
    return sorted(repr([round(v, 5) + 0.0 if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.skipif(not Path(DATA).exists(), reason="tables are absent")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DATA)
    cur = con.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert norm(map(tuple, df.select(names).collect())) == norm(cur.fetchall())


@pytest.mark.skipif(not Path(DATA).exists(), reason="tables are absent")
@pytest.mark.parametrize("name", ["near_dup_reviews", "review_tally"])
def test_pairs_are_found_once(spark, name):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan
    spark.catalog.clearCache()
