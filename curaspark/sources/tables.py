"""CSV, Parquet, JSON and Markdown files around the pipeline."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curaspark import schemas
from curaspark.operators import contracts


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header under an explicit schema; quoted commas and line breaks are read as text."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_manifest(rows: DataFrame, path: str, dataset_doi: str) -> DataFrame:
    """Checks hashes and splits, then writes the manifest's ten columns; returns what was written."""
    contracts.manifest_splits(contracts.unique_hashes(rows))
    out = rows.withColumn("dataset_doi", F.lit(dataset_doi)).select(schemas.MANIFEST.names)
    write_file(out, path)
    return out


def write_file(df: DataFrame, path: str) -> None:
    """One CSV file at path: written beside it and moved into place, so that a failed run leaves the earlier file whole."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    target, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    store = target.getFileSystem(conf)
    write_csv(df, path + ".part")
    part = next(f.getPath() for f in store.listStatus(aside) if f.getPath().getName().startswith("part-"))
    store.delete(target, True)
    if not store.rename(part, target):
        raise OSError(f"{part} could not be moved to {path}")
    store.delete(aside, True)


def copy_result(spark: SparkSession, source: str, folder: str) -> str:
    """Copies a file (an index, the record of a run) into a folder of results; returns its new path."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a = jvm.org.apache.hadoop.fs.Path(source)
    b = jvm.org.apache.hadoop.fs.Path(folder, a.getName())
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
    return b.toString()


def previous_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of an earlier manifest."""
    return read_csv(spark, path, schemas.MANIFEST).filter("archive_member <> ''").select(F.col("archive_member").alias("member_path"))


def save_embeddings(df: DataFrame, path: str) -> None:
    contracts.aligned(df).write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return contracts.aligned(spark.read.schema(schemas.EMBEDDINGS).parquet(path))


def save_json(data: dict, path: str) -> None:
    """UTF-8, sorted keys, two spaces, a newline at the end; written beside and moved into place."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    part.write_text(json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    os.replace(part, target)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small report table; floats with three decimals."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has {most} rows at most")

    def cell(v) -> str:
        return f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v)

    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def load_config(path: str) -> dict:
    """Configuration from YAML where PyYAML is installed, else JSON; the sections paths, data and quality must be there."""
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(path)
    text = p.read_text(encoding="utf-8")
    if p.suffix in (".yml", ".yaml"):
        try:
            import yaml
        except ImportError as e:
            raise contracts.ContractError("PyYAML is not installed; give the configuration as JSON") from e
        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    if not isinstance(data, dict):
        raise contracts.ContractError("the configuration must be a mapping")
    missing = [s for s in ("paths", "data", "quality") if s not in data]
    if missing:
        raise contracts.ContractError(f"missing sections: {', '.join(missing)}")
    return data


def provenance(spark: SparkSession, files: dict[str, str], **more) -> dict:
    """Versions, commit and SHA-256 of the inputs of a run."""
    import hashlib
    import platform
    import subprocess
    from datetime import datetime, timezone

    def digest(path: str) -> str:
        h = hashlib.sha256()
        with open(path, "rb") as f:
            while chunk := f.read(1 << 20):
                h.update(chunk)
        return h.hexdigest()

    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        commit = None
    out = {"created_utc": datetime.now(timezone.utc).isoformat(), "spark_version": spark.version, "python_version": platform.python_version(), "git_commit": commit}
    return out | {f"{k}_sha256": digest(p) for k, p in files.items()} | more
