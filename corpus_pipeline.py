"""The corpus pipeline: documents through five operators; every stage is written and read again by the next.

quality rules and quality classifier drop the documents that they reject; line dedup shortens texts and drops documents
of which no word is left; the Jaccard join keeps one document of each group of near duplicates; packing cuts what is
left into training sequences.

Defined results, for each stage: an empty table gives no rows (the classifier also with an empty ``labels``); all columns
of docs pass through the first four stages, also those named like a column that the operator adds; a row with a null
doc_id or lang is treated like others (lang as ``und``); null and empty texts are rejected by the rules, and if a stage
meets them without: scored like others, left alone by line dedup, all kept by the Jaccard join, an end id in packing. Of
rows that repeat doc_id and text, the Jaccard join keeps one; of ties, the smallest doc_id, then the smallest text hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.llm import bytenet, common, jaccard, lines, packing, perplexity
from curaspark.llm.common import table
from curaspark.llm.queries import tokenizer_path


def _apart(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that an operator leaves, with the columns of docs. Those that it does not read are renamed meanwhile, so
    that none gives way to a column that it adds."""
    names = {c: c if c in ("doc_id", "text", "lang") else f"__c{i}" for i, c in enumerate(docs.columns)}
    out = operator(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the perplexity bands of this input keep; those at the end of a band stay."""
    return _apart(docs, lambda d: perplexity.quality_rules(d).filter("kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of this input, doesn't reject: a score of 0.3 or more."""
    net = bytenet.fit(docs, table(spark, sf_dir, "labels"))
    return _apart(docs, lambda d: bytenet.classify(d, net).filter("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one or lie within one word edit of it. A document that loses all its
    words this way goes: what it held is in others."""
    left = (F.col("n_lines_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return _apart(docs, lambda d: lines.dedup_lines(d).filter(left))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a 5-word Jaccard similarity of 0.75 or more."""
    return _apart(docs, jaccard.keep_one)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

#: Perplexity, the network and the tokenizer have no SQL form; tests/llm hold the operators
#: against brute force, and each stage against its operator, instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet in the shared folder and read again. A stage's input and what it
    left there go once its result is written; the last stage's result stays."""
    docs, before, folder = table(spark, sf_dir, "documents"), common.written(), None
    for name, stage in STAGES:
        folder = common.new_folder(spark, f"corpus_pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        common.clean(spark, but=before | {folder})
        docs = spark.read.parquet(folder)
    return docs
