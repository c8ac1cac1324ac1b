"""Model inputs, embedding of images, normalisation, prototypes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curaspark.functions.scalar import normalised, split_rank, strict_boolean

from .contracts import ContractError, disjoint_splits, require_columns, unique


def numbered(rows: DataFrame, strata: list[str], order: list[str], name: str) -> DataFrame:
    """Dense numbers from 0 in the order of strata, then order. Ranks inside a stratum plus the sizes of those before it, so
    that no task sorts the whole table."""
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy(*strata).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(*strata).orderBy(*order)))
    return ranked.join(before, strata).withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_r", "_before")


def select_model_inputs(report: DataFrame) -> DataFrame:
    """Approved rows with embedding_row, train before val before test. Fails on repeated samples or shared splits."""
    require_columns(report, ["sample_id", "mode", "split", "class_name", "path", "use_for_model"])
    rows = report.filter(strict_boolean("use_for_model"))
    if rows.isEmpty():
        raise ContractError("no approved rows")
    unique(rows, ["sample_id", "mode", "split", "class_name"])
    disjoint_splits(rows)
    return number_inputs(rows)


def number_inputs(rows: DataFrame) -> DataFrame:
    placed = rows.withColumn("_split", split_rank("split"))
    return numbered(placed, ["_split", "mode", "class_name"], ["sample_id"], "embedding_row").select("embedding_row", "sample_id", "mode", "split", "class_name", "path")


Embedder = Callable[[list[np.ndarray]], np.ndarray]


def frequency_embedder(batch: list[np.ndarray], size: int = 384) -> np.ndarray:
    """Stand-in for a frozen network, whose weights cannot be had offline: low frequencies of the mean of the three colours,
    unit length."""
    from .integrity import area_resize, dct_matrix

    n = 32
    d = dct_matrix(n)
    at = sorted(((i, j) for i in range(n) for j in range(n)), key=lambda p: (p[0] + p[1], p))[1 : size + 1]
    out = np.array([[low[p] for p in at] for low in (d @ area_resize(g, n) @ d.T for g in (x.mean(2) if x.ndim == 3 else x for x in batch))], np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_images(index: DataFrame, images: DataFrame, embedder: Embedder = frequency_embedder, batch_size: int = 16) -> DataFrame:
    """index with an embedding of each image; the embedder gets batch_size RGB images a call. A row whose image is absent or
    cannot be decoded fails."""
    if batch_size < 1:
        raise ContractError("batch_size must be above 0")
    from curaspark.sources.images import to_rgb

    columns = ["embedding_row", "sample_id", "mode", "split", "class_name", "path"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), batch_size):
                x = b.iloc[a : a + batch_size]
                lost = x["path"][x["height"].isna() | (x["height"] <= 0)]
                if len(lost):
                    raise ContractError(f"no image: {', '.join(lost.astype(str).head(20))}")
                pictures = [to_rgb(r.data, int(r.height), int(r.width), int(r.nChannels)) for r in x.itertuples()]
                yield x[columns].assign(embedding=list(embedder(pictures)))

    kind = "embedding_row long, sample_id string, mode string, split string, class_name string, path string, embedding array<float>"
    return index.select(*columns).join(images, "path", "left").mapInPandas(run, kind)


def l2_normalise(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, normalised(column))


def prototypes(index: DataFrame, split: str = "train") -> DataFrame:
    """mode, class_name, pos, x: components of the normalised mean vector of each class. A class that the split lacks fails."""
    lost = index.select("mode", "class_name").distinct().join(index.filter(F.col("split") == split), ["mode", "class_name"], "left_anti")
    if not lost.isEmpty():
        raise ContractError(f"classes without {split} rows: {lost.limit(20).collect()}")
    return mean_directions(index.filter(F.col("split") == split))


def mean_directions(rows: DataFrame) -> DataFrame:
    mean = rows.select("mode", "class_name", F.posexplode("embedding").alias("pos", "x")).groupBy("mode", "class_name", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    length = mean.groupBy("mode", "class_name").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return mean.join(length, ["mode", "class_name"]).select("mode", "class_name", "pos", (F.col("x") / F.col("len")).alias("x"))


def prototype_similarity(protos: DataFrame) -> DataFrame:
    """Cosine of every two classes; they meet component by component."""
    a, b = protos.alias("a"), protos.alias("b")
    cos = a.join(b, F.col("a.pos") == F.col("b.pos")).groupBy(F.col("a.mode").alias("source_mode"), F.col("a.class_name").alias("source_class"), F.col("b.mode").alias("target_mode"), F.col("b.class_name").alias("target_class"))
    return cos.agg(F.sum(F.col("a.x") * F.col("b.x")).alias("cosine_similarity")).withColumn("same_class", F.col("source_class") == F.col("target_class"))


def alignment_gap(similarity: DataFrame, source: str = "PPL", target: str = "XPL") -> DataFrame:
    """Mean similarity of equal and of different classes across modes, and the difference."""
    across = similarity.filter((F.col("source_mode") == source) & (F.col("target_mode") == target))
    same, other = (F.avg(F.when(F.col("same_class") == v, F.col("cosine_similarity"))) for v in (True, False))
    return across.agg(same.alias("same_class_mean"), other.alias("different_class_mean"), (same - other).alias("alignment_gap"))


def similarity_table(similarity: DataFrame) -> DataFrame:
    """Source classes as rows, target classes as columns."""
    return similarity.groupBy("source_mode", "source_class").pivot("target_class").agg(F.first("cosine_similarity"))
