"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, then exact distances of what survives.

The queries are packed into blocks, one file of the shared folder each. A task that reads candidates fills a block of
them and lets all query blocks pass by it (the query set is stated, so this is no cross join of rows): candidates are
never shuffled, and a task holds one block of either side. In a tile, the product of the int8 codes gives each distance up
to a bound from the quantisation errors of both vectors; a pair survives if its least possible distance does not exceed
the k-th smallest greatest possible distance of its query. Survivors are computed in double precision from the original
vectors, and bounded heaps keep the k best per tile, per task and then per query.

This is done twice: against one in ``sample`` of the candidates first, which gives every query a distance that its k-th
neighbour cannot exceed. With it the second pass, against all, hands on only what lies within, so that the result does
not grow with the number of tasks. The limit is one of true distances: nothing is lost.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids;
vectors of another length than the query's are no candidates; a query with fewer candidates than k returns all; ties go
to the smaller vec_id; rows that repeat a vec_id are candidates one by one, but none of the query's own id. Query rows
that repeat both id and vector are one query; other vectors of the same id are queries of their own, told apart by
query_key. Columns other than vec_id and embedding are not read; an empty table on either side gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

OUTPUT = "query_id long, rank int, vec_id long, score double, query_key long"
FOUND = "query_key long, query_id long, vec_id long, score double"
#: Bytes of vectors (as float64) in a block of candidates.
BLOCK_BYTES = 16_000_000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & e.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))


class QueryBlock:
    """Queries of one length: keys, ids, distances that the result need not exceed, vectors and their codes."""

    def __init__(self, data: bytes, dim: int):
        rows = len(data) // (24 + 8 * dim)
        self.key, self.id = (np.frombuffer(data, np.int64, rows, 8 * rows * k) for k in (0, 1))
        self.limit = np.frombuffer(data, np.float64, rows, 16 * rows)
        self.x = np.frombuffer(data, np.float64, rows * dim, 24 * rows).reshape(rows, dim)
        self.codes = quantise(self.x)

    @staticmethod
    def to_bytes(key: list, ids: list, limit: list, x: list) -> bytes:
        return np.array(key, np.int64).tobytes() + np.array(ids, np.int64).tobytes() + np.array(limit, np.float64).tobytes() + np.array(x, np.float64).tobytes()


def write_blocks(queries: DataFrame, folder: str, rows: int) -> None:
    """queries (key, vec_id, embedding, limit) as files <dim>-<partition>-<number>; queries of one length in each."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, {}
        for batch in common.leanly(batches):
            for r in zip(batch["key"], batch["vec_id"], batch["limit"], batch["embedding"], strict=True):
                block = held.setdefault(len(r[3]), [])
                block.append(r)
                if len(block) == rows:
                    common.write_file(f"{folder}/{len(r[3])}-{part}-{number}", QueryBlock.to_bytes(*zip(*block, strict=True)))
                    number += 1
                    block.clear()
        for dim, block in held.items():
            if block:
                common.write_file(f"{folder}/{dim}-{part}-{number}", QueryBlock.to_bytes(*zip(*block, strict=True)))
                number += 1
        yield pd.DataFrame({"n": [number]})

    queries.mapInPandas(pack, "n int").count()


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale of each row, and the length of its rounding error."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs, summed one component after the other in double precision."""
    return np.sqrt(np.cumsum((a - b) ** 2, axis=1)[:, -1]) if len(a) else np.zeros(0)


def tile(q: QueryBlock, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, list]]:
    """The k nearest candidates of each query within a tile: (place of the query, [(distance, candidate)])."""
    qq, qs, qe = q.codes
    cq, cs, ce = quantise(c)
    wide = np.float32 if c.shape[1] <= 1000 else np.float64  # sums of int8 products stay exact in these
    dot = (qq.astype(wide) @ cq.astype(wide).T).astype(np.float64) * qs[:, None] * cs
    qn, cn = np.sqrt((q.x * q.x).sum(1)), np.sqrt((c * c).sum(1))
    off = qe[:, None] * (cn + ce) + qn[:, None] * ce  # |q.c - dot| <= |eq||c - ec| + |q - eq||ec| + |eq||ec|, and looser
    square = (qn**2)[:, None] + cn**2
    slack = 1e-9 * (square + 1)
    low, high = square - 2 * (dot + off) - slack, square - 2 * (dot - off) + slack
    own = q.id[:, None] == cid
    low[own] = high[own] = np.inf
    limit = np.partition(high, k - 1, axis=1)[:, k - 1] if len(cid) > k else np.full(len(q.id), np.inf)
    limit = np.minimum(limit, q.limit**2 * (1 + 1e-9))
    i, j = np.nonzero((low <= limit[:, None]) & ~own)
    d = exact(q.x[i], c[j])
    near = d <= q.limit[i]
    i, j, d = i[near], j[near], d[near]
    bounds = np.searchsorted(i, np.arange(len(q.id) + 1)).tolist()
    return [(n, heapq.nsmallest(k, zip(d[a:b].tolist(), cid[j[a:b]].tolist(), strict=True))) for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]


def push(heap: list, k: int, distance: float, vec_id: int) -> None:
    """A heap of the k least (distance, vec_id), the greatest on top."""
    (heapq.heappushpop if len(heap) == k else heapq.heappush)(heap, (-distance, -vec_id))


def meet(vectors: DataFrame, folder: str, k: int, strip: int) -> DataFrame:
    """FOUND: for each task and query block the k best candidates of each query."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in common.leanly(batches):
            for i, v in zip(batch["vec_id"].tolist(), batch["embedding"], strict=True):
                block = held.setdefault(len(v), [])
                block.append((i, v))
                if len(block) * len(v) * 8 >= BLOCK_BYTES:
                    yield from pass_by(len(v), block)
                    block.clear()
        for dim, block in held.items():
            if block:
                yield from pass_by(dim, block)

    def pass_by(dim: int, block: list) -> Iterator[pd.DataFrame]:
        ids, x = np.array([i for i, _ in block], np.int64), np.array([v for _, v in block], np.float64)
        for name in common.list_files(folder):
            if name.split("-")[0] != str(dim):
                continue
            q = QueryBlock(common.read_file(f"{folder}/{name}"), dim)
            heaps: dict[int, list] = {}
            for at in range(0, len(ids), strip):
                for n, best in tile(q, ids[at : at + strip], x[at : at + strip], k):
                    for d, v in best:
                        push(heaps.setdefault(n, []), k, d, v)
            rows = [(int(q.key[n]), int(q.id[n]), -v, -d) for n, h in heaps.items() for d, v in h]
            if rows:
                yield pd.DataFrame(rows, columns=["query_key", "query_id", "vec_id", "score"])

    return vectors.mapInPandas(work, FOUND)


def merge(found: DataFrame, k: int) -> DataFrame:
    """OUTPUT: one heap of k for each query of a task's share of queries."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[tuple[int, int], list] = {}
        for batch in common.leanly(batches):
            for key, i, v, s in zip(*(batch[c].tolist() for c in ("query_key", "query_id", "vec_id", "score")), strict=True):
                push(heaps.setdefault((key, i), []), k, s, v)
        rows = [(i, r, -v, -s, key) for (key, i), h in heaps.items() for r, (s, v) in enumerate(sorted(h, reverse=True), 1)]
        yield pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score", "query_key"])

    return found.repartition("query_key", "query_id").mapInPandas(work, OUTPUT)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = 512, sample: int = 32, strip: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest vectors of each query by Euclidean distance, query_key.

    A task holds a block of candidates, a block of queries and a tile of query_block x strip distances.
    """
    spark = vectors.sparkSession
    pool = usable(vectors)
    asked = common.cut(usable(queries).dropDuplicates(["vec_id", "embedding"]).select(F.xxhash64("vec_id", "embedding").alias("key"), "vec_id", "embedding"))
    some, whole = common.new_folder(spark, "queries"), common.new_folder(spark, "queries")
    write_blocks(asked.withColumn("limit", F.lit(float("inf"))), some, query_block)
    first = merge(meet(pool.filter(F.pmod(F.xxhash64("vec_id"), F.lit(sample)) == 0), some, k, strip), k)
    limits = first.filter(F.col("rank") == k).select(F.col("query_key").alias("key"), F.col("query_id").alias("vec_id"), F.col("score").alias("limit"))
    limited = asked.join(limits, ["key", "vec_id"], "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    write_blocks(limited, whole, query_block)
    found = common.cut(meet(pool, whole, k, strip))
    common.drop(asked)
    common.remove(spark, some)
    common.remove(spark, whole)
    return merge(found, k)
