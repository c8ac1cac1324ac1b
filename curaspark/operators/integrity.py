"""Perceptual hashes, near duplicates across splits, and their reviews."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions.scalar import hamming
from curaspark.schemas import NEAR_DUPLICATE_KEY

from .contracts import ContractError, review_file, unique
from .contracts import join_reviews as contracts_join

DECISIONS = ("distinct_keep", "exclude_train_near_duplicate")
HASH_BITS = 64


def pack_bits(v: Column, bits: int = HASH_BITS) -> Column:
    """Long whose bits, first component highest, tell which components exceed the median of all but the first; bit of the
    first is 0. For an odd number of others the median is the middle one."""
    rest = F.slice(v, 2, bits - 1)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def packed(median: Column) -> Column:
        return F.aggregate(rest, none, lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > median, one).otherwise(none)))

    # a variable of a lambda is computed once, not once for each component
    return F.transform(F.array(F.element_at(F.sort_array(rest), bits // 2)), packed)[0]


def area_resize(g: np.ndarray, size: int) -> np.ndarray:
    """Mean of the source area under each target pixel."""

    def weights(n: int) -> np.ndarray:
        edge = np.linspace(0, n, size + 1)
        at = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, 1) * (size / n)

    return weights(g.shape[0]) @ g.astype(np.float64) @ weights(g.shape[1]).T


def dct_matrix(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def perceptual_hash(gray: np.ndarray, hash_size: int = 8) -> int:
    if not 2 <= hash_size <= 8:
        raise ContractError("hash_size must be from 2 to 8")
    n = 4 * hash_size
    d = dct_matrix(n)
    low = (d @ np.rint(area_resize(gray, n)) @ d.T).astype(np.float32)[:hash_size, :hash_size].ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return int("".join("1" if b else "0" for b in bits), 2)


def hash_images(images: DataFrame, hash_size: int = 8) -> DataFrame:
    """path and phash of decoded images (see sources.images.gray)."""
    from curaspark.sources.images import to_gray

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.path, perceptual_hash(to_gray(r.data, r.height, r.width, r.nChannels), hash_size)) for r in b.itertuples()]
            yield pd.DataFrame(rows, columns=["path", "phash"])

    return images.filter("height > 0").select("path", "height", "width", "nChannels", "data").mapInPandas(run, "path string, phash long")


def near_duplicates(hashed: DataFrame, max_distance: int = 4) -> DataFrame:
    """Pairs of one mode and class from different splits with hashes at most max_distance apart.

    hashed: row_id (orders the two sides of a pair), mode, class_id, split, sample_id, archive_member, phash. Up to distance 7
    pairs are found by bands: of max_distance + 1 bands one must be equal, so candidates are joined on (band, bits)
    and each pair is kept in its first equal band alone. Beyond that bands get too short and all pairs of a mode and class meet,
    block by block as bits in numpy.
    """
    if max_distance < 0:
        raise ContractError("max_distance must not be negative")
    rows = hashed.filter(F.col("mode").isNotNull() & F.col("class_id").isNotNull() & F.col("row_id").isNotNull() & F.col("split").isNotNull() & F.col("phash").isNotNull())
    found = _banded_pairs(rows, max_distance) if max_distance < 8 else _block_pairs(rows, max_distance)
    return found.orderBy("distance", "mode", "class_id", "split_a", "sample_id_a", "split_b", "sample_id_b")


PAIR = ["mode", "class_id", "split_a", "sample_id_a", "split_b", "sample_id_b", "archive_member_a", "archive_member_b", "distance"]


def _banded_pairs(rows: DataFrame, max_distance: int) -> DataFrame:
    # dealt out once, so that neither side of the join computes a hash again for every pair
    rows, bands = rows.repartition("row_id"), max_distance + 1
    edge = [k * HASH_BITS // bands for k in range(bands + 1)]
    masks = [((1 << edge[k + 1]) - (1 << edge[k])) for k in range(bands)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    rows = rows.select("*", F.posexplode(F.array(*[F.col("phash").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "bits"))
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.mode") == F.col("b.mode")) & (F.col("a.class_id") == F.col("b.class_id")) & (F.col("a.row_id") < F.col("b.row_id")) & (F.col("a.split") != F.col("b.split"))
    on = on & (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits"))
    pairs = a.join(b, on & (hamming("a.phash", "b.phash") <= max_distance))
    x = F.col("a.phash").bitwiseXOR(F.col("b.phash"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(masks)])
    pairs = pairs.filter(F.col("a.band") == first)
    return pairs.select("a.mode", "a.class_id", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("split", "sample_id") for s in "ab"], *[F.col(f"{s}.archive_member").alias(f"archive_member_{s}") for s in "ab"], hamming("a.phash", "b.phash").alias("distance")).select(*PAIR)


def _block_pairs(rows: DataFrame, max_distance: int, block: int = 8192) -> DataFrame:
    """All pairs of a mode and class: its rows are dealt over blocks, and every two blocks meet in one task."""
    most = rows.groupBy("mode", "class_id").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // block))
    rows = rows.select("row_id", "mode", "class_id", "split", "sample_id", "archive_member", "phash").withColumn("_b", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")})
    keys = ["mode", "class_id", "_i", "_j"]
    kind = ", ".join(f"{c} {dict(rows.dtypes)[c.removesuffix('_a').removesuffix('_b')]}" for c in PAIR[:-1]) + ", distance int"

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        one, n = key[2].as_py() == key[3].as_py(), t.num_rows
        side = t["_b"].to_numpy()
        left, right = (np.flatnonzero(side == k.as_py()) for k in key[2:])
        place = pc.rank(t["row_id"].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
        split = t["split"].combine_chunks().dictionary_encode().indices.to_numpy()
        bits = t["phash"].to_numpy().view(np.uint64)
        a, b, far = [], [], []
        for e in range(0, len(left), 64):
            i = left[e : e + 64]
            j = right[e:] if one else right
            d = np.bitwise_count(bits[i][:, None] ^ bits[j])
            p, q = np.divmod(np.flatnonzero(d.ravel() <= max_distance), max(1, len(j)))
            u, v = i[p], j[q]
            keep = (split[u] != split[v]) & (place[u] != place[v])
            if one:
                keep &= q > p  # from the diagonal on, each pair once
            u, v, near = u[keep], v[keep], d[p[keep], q[keep]]
            turned = place[u] > place[v]
            a.append(np.where(turned, v, u))
            b.append(np.where(turned, u, v))
            far.append(near)
        a, b, far = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, far))
        out = [t[c.removesuffix("_a").removesuffix("_b")].take(b if c.endswith("_b") else a) for c in PAIR[:-1]]
        return pa.table([*out, pa.array(far.astype(np.int32))], names=PAIR)

    # so many partitions that tasks are small even where a few groups hold most rows
    return rows.repartition(max(8, min(4 * blocks * (blocks + 1), 4000)), *keys).groupBy(*keys).applyInArrow(run, kind)


def apply_near_duplicate_reviews(report: DataFrame, reviews: DataFrame) -> DataFrame:
    """Report with decision (pending_review where no review fits) and notes. Reviews that fit nothing are dropped."""
    review_file(reviews, NEAR_DUPLICATE_KEY, "decision", DECISIONS)
    unique(report, NEAR_DUPLICATE_KEY)
    return join_reviews(report, reviews)


def join_reviews(report: DataFrame, reviews: DataFrame) -> DataFrame:
    out = contracts_join(report, reviews, NEAR_DUPLICATE_KEY, ["decision", "notes"])
    return out.withColumns({"decision": F.coalesce("decision", F.lit("pending_review")), "notes": F.coalesce("notes", F.lit(""))})


def review_tally(reviewed: DataFrame) -> DataFrame:
    return reviewed.agg(F.count_if(F.col("decision") == "pending_review").alias("pending"), F.count_if(F.col("decision") != "pending_review").alias("reviewed"))
