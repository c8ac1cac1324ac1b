"""The catalog as a stream: image files are listed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def watch_files(spark: SparkSession, root: str, glob: str = "*.{jpg,jpeg,png,tif,tiff}") -> DataFrame:
    """path and length of new files below root, without their content."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return stream.option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")
