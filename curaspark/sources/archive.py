"""ZIP archives: an index as a data source, resumable member downloads, quarantine of stale files."""

from __future__ import annotations

import hashlib
import os
import shutil
import time
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from curaspark.operators.contracts import ContractError

INDEX = "member_path string, file_size long, compress_size long"


class ZipIndex(DataSource):
    """format("zipindex"): one row per file of an archive, from its central directory alone."""

    @classmethod
    def name(cls) -> str:
        return "zipindex"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options["path"])


class _ZipReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.value) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield m.filename, m.file_size, m.compress_size


def zip_index(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ZipIndex)
    return spark.read.format("zipindex").option("path", path).load()


def retry_delay(attempt: int, base: float, most: float = 30.0) -> float:
    """Seconds before the attempt after this one."""
    return min(base * 2 ** (attempt - 1), most)


def fetch(opener: Callable, member: str, size: int, target: Path, attempts: int = 1, backoff: float = 0.0, chunk: int = 1 << 20, sleep=time.sleep) -> tuple[int, str]:
    """Copies a member to target unless a file of its size is there; returns bytes and SHA-256. A failed attempt leaves no part."""
    if attempts < 1 or backoff < 0:
        raise ContractError("attempts must be above 0 and backoff not negative")
    part = target.with_name(target.name + ".part")
    if not (target.is_file() and target.stat().st_size == size):
        target.parent.mkdir(parents=True, exist_ok=True)
        for attempt in range(1, attempts + 1):
            try:
                with opener(member) as source, part.open("wb") as out:
                    shutil.copyfileobj(source, out, chunk)
                if part.stat().st_size != size:
                    raise OSError(f"{member}: {part.stat().st_size} bytes instead of {size}")
                os.replace(part, target)
                break
            except OSError:
                part.unlink(missing_ok=True)
                if attempt == attempts:
                    raise
                sleep(retry_delay(attempt, backoff))
    h = hashlib.sha256()
    with target.open("rb") as f:
        while data := f.read(chunk):
            h.update(data)
    return target.stat().st_size, h.hexdigest()


def download(selected: DataFrame, archive: str, root: str, attempts: int = 5, backoff: float = 2.0) -> DataFrame:
    """selected (member_path, file_size, local_relative_path, ...) with bytes and sha256 of the files written below root.
    Repeating a task is harmless: what is complete is only hashed again."""
    columns = selected.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with zipfile.ZipFile(archive) as z:
            for b in batches:
                got = [fetch(z.open, r.member_path, r.file_size, Path(root) / r.local_relative_path, attempts, backoff) for r in b.itertuples()]
                yield b.assign(bytes=[g[0] for g in got], sha256=[g[1] for g in got])

    return selected.mapInPandas(run, columns.simpleString()[len("struct<") : -1].replace(":", " ") + ", bytes long, sha256 string")


def quarantine(paths: list[str], root: str, quarantine_root: str) -> list[str]:
    """Moves files out of root. One that is already there with the same content is removed; another content fails."""
    moved = []
    for rel in paths:
        source, target = Path(root) / rel, Path(quarantine_root) / rel
        if not source.exists():
            continue
        if target.exists():
            if source.read_bytes() != target.read_bytes():
                raise FileExistsError(target)
            source.unlink()
        else:
            target.parent.mkdir(parents=True, exist_ok=True)
            shutil.move(source, target)
        moved.append(rel)
    return moved
