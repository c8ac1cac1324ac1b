"""Catalog of an image tree mode/split/class/**/file, and its pairs of modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.functions.scalar import stem, suffix

from .contracts import unique


def build_catalog(spark: SparkSession, root: str, modes, splits, extensions) -> DataFrame:
    """One row for each image; only path and length of the files are read."""
    wanted = [("." + e.lstrip(".")).lower() for e in extensions]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return catalog_rows(files, root, modes, splits, wanted)


def catalog_rows(files: DataFrame, root: str, modes, splits, wanted) -> DataFrame:
    base = root.split(":", 1)[-1].rstrip("/").lstrip("/")
    rel = F.regexp_extract("path", "^(?:[a-z]+:)?/*\\Q" + base + "\\E/(.*)$", 1)
    piece = F.split(rel, "/")
    rows = files.withColumn("p", piece).filter(F.size("p") >= 4)
    name = F.element_at("p", -1)
    rows = rows.select(stem(name).alias("sample_id"), F.col("p")[0].alias("mode"), F.col("p")[1].alias("split"), F.col("p")[2].alias("class_name"), "path", suffix(name).alias("extension"), F.col("length").alias("file_size_bytes"))
    rows = rows.filter(F.col("mode").isin(*modes) & F.col("split").isin(*splits) & F.col("extension").isin(*wanted))
    unique(rows, ["split", "class_name", "sample_id", "mode"], "duplicate images")
    return rows.orderBy("split", "class_name", "sample_id", "mode")


def modality_pairs(catalog: DataFrame, first: str = "PPL", second: str = "XPL") -> DataFrame:
    """Paths of both modes of each sample, null where one is absent, and whether both are there."""
    unique(catalog.filter(F.col("mode").isin(first, second)), ["sample_id", "split", "class_name", "mode"], "duplicate paths")
    return pair_table(catalog, first, second)


def pair_table(catalog: DataFrame, first: str = "PPL", second: str = "XPL") -> DataFrame:
    wide = catalog.filter(F.col("mode").isin(first, second)).groupBy("sample_id", "split", "class_name").pivot("mode", [first, second]).agg(F.first("path"))
    a, b = F.col(first), F.col(second)
    return wide.select("sample_id", "split", "class_name", a.alias(f"path_{first}"), b.alias(f"path_{second}"), (a.isNotNull() & b.isNotNull()).alias("has_pair")).orderBy("split", "class_name", "sample_id")
