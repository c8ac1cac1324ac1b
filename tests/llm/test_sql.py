"""Queries that SQL can express give DuckDB's rows, on the smallest tables and on odd ones."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from curaspark.llm import queries

DATA = "/root/testdata/sf0.001"


def agree(spark, sf_dir, name):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    df = queries.QUERIES[name](spark, sf_dir)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(names).collect())))
    assert got and got == sorted(map(repr, cur.fetchall()))


@pytest.mark.skipif(not Path(DATA).exists(), reason="tables are absent")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_smallest_tables(spark, name):
    agree(spark, DATA, name)


def test_odd_documents(spark, tmp_path):
    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    texts = [None, "", " \n\t ", "a b", "A  B", "one two three four five\n\none two three four six\none two three four", "ONE two three four five"]
    texts += ["\n".join(" ".join(r.choice(words, r.integers(3, 8))) for _ in range(4)) for _ in range(40)]
    texts += [t.replace("w1 ", "w2 ", 1) for t in texts[-20:]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op4_line_dedup", "op9_jaccard_join"):
        agree(spark, str(tmp_path), name)
