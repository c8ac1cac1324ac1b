"""The pipeline's stages on odd tables, each against its operator, and run() from tables to sequences."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curaspark.llm import bytenet, common, jaccard, lines, perplexity

WORDS = "the quick brown fox jumps over lazy dog while seven wise owls watch from an old oak tree near river bank stone".split()
SCHEMA = "doc_id long, text string, lang string, source string, kept string, SCORE int, n_lines_dropped double, h int, node string"


def corpus():
    r = np.random.default_rng(6)
    rows = [(i, "\n".join(" ".join(r.choice(WORDS, 14)) for _ in range(6)), "en") for i in range(60)]
    rows += [(60 + i, " ".join(r.choice(WORDS, 60)) + " $$$ ### &&&" * 20, "en") for i in range(20)]  # rejected by the labels
    rows += [(90, rows[3][1], "en"), (91, rows[4][1].replace("fox", "cat", 1), "en"), (3, rows[3][1], "en")]  # a copy, a near copy, a repeated row
    rows += [(92, None, "en"), (93, "", None), (94, " \n\t", "en"), (None, rows[5][1], None), (95, " ".join(r.choice(WORDS, 30_000)), "en")]
    return [(*x, "s", "clash", 7, 0.5, i, "n") for i, x in enumerate(rows)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def texts(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect()))


@pytest.mark.parametrize("k", range(5))
def test_empty_table(spark, tables, k):
    docs = common.table(spark, tables, "documents").limit(0)
    got = corpus_pipeline.STAGES[k][1](spark, docs, tables)
    assert got.count() == 0 and (k == 4 or got.columns == docs.columns)


def test_filters_keep_columns_and_take_effect(spark, tables):
    docs = common.table(spark, tables, "documents")
    ruled = corpus_pipeline.quality_rules(spark, docs, tables)
    plain = docs.select("doc_id", "text", "lang")
    assert ruled.schema == docs.schema and ruled.filter("kept <> 'clash' or SCORE <> 7").count() == 0
    assert texts(ruled) == texts(perplexity.quality_rules(plain).filter("kept"))
    assert ruled.filter("doc_id in (92, 93, 94)").count() == 0
    net = bytenet.fit(docs, common.table(spark, tables, "labels"))
    judged = corpus_pipeline.quality_classifier(spark, docs, tables)
    assert judged.schema == docs.schema and texts(judged) == texts(bytenet.classify(plain, net).filter("predicted = 1"))
    assert 0 < judged.filter("doc_id < 80").count() < 80


def test_line_dedup_drops_what_has_no_words_left(spark, tables):
    docs = common.table(spark, tables, "documents")
    got = corpus_pipeline.line_dedup(spark, docs, tables)
    whole = lines.dedup_lines(docs.select("doc_id", "text")).filter("n_lines_dropped = 0 or trim(translate(text, '\n', '')) <> ''")
    assert got.schema == docs.schema and texts(got) == texts(whole)
    ids = {r.doc_id for r in got.collect()}
    assert 90 not in ids and {3, 92, 93, 94, 95} <= ids  # 90 repeats all lines of 3


def test_near_duplicates_keep_one(spark, tables):
    docs = common.table(spark, tables, "documents")
    got = corpus_pipeline.near_duplicates(spark, docs, tables)
    ids = [r.doc_id for r in got.collect()]
    groups = jaccard.jaccard_components(docs).filter("n_shingles > 0")
    assert got.schema == docs.schema and len(ids) == groups.select("component_id").distinct().count() + groups.sparkSession.range(3).count()
    assert ids.count(3) == 1 and not {90, 91, None} & set(ids) and {92, 93, 94} <= set(ids)


def test_run(spark, tables):
    before = common.written()
    got = corpus_pipeline.run(spark, tables)
    rows = got.collect()
    assert rows and {r.doc_id for r in rows} <= set(range(60)) | {95}
    size = {}
    for r in rows:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    assert max(size.values()) <= 2048
    for d, pieces in {d: sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == d) for d in {r.doc_id for r in rows}}.items():
        assert sum(n for _, n, _ in pieces) == pieces[0][2] and pieces[0][0] == 0, d
    left = common.written() - before
    assert len(left) == 1 and os.path.isdir(common.local_path(left.pop()))  # the result alone
    assert got.filter(F.col("doc_id") == 90).count() == 0


def test_settings_are_left_alone(spark, tables):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = common.table(spark, tables, "documents")
    before = spark.conf.get(key)
    jaccard.jaccard_components(docs).count()
    perplexity.quality_rules(docs).count()
    assert spark.conf.get(key) == before
    common.clean(spark)
