"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; filters of 8 bytes slide over the whole text in steps of 4; their rectified outputs are max-pooled
over chunks of 512 bytes that overlap by half. The mean and the maximum of all chunks' vectors go to one logistic unit.
All weights are learned by Adam on a bounded sample of labelled documents (``sample`` of them, ``train_chunks``
chunks of each, spread over the text); scoring reads every byte.

Defined results: a null or empty text has the score of the bias alone; null or repeated ids are scored like others;
without training rows every score is 0.5; an empty table gives no rows; extra columns stay, but for those of the
result's names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

STEP, HALF = 4, 256
EMBED, FILTERS = 8, 24
_HALF_STEPS = HALF // STEP


def held_out(fold: int, of: int) -> Column:
    """Whether crc32 of doc_id as text falls into the fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold, F.lit(False))


def _blocks(text: str) -> np.ndarray:
    """A text's bytes as rows of HALF, the last padded with zeros; one row more than chunks."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    rows = max(2, -(-len(b) // HALF)) if len(b) else 0
    out = np.zeros(rows * HALF, np.uint8)
    out[: len(b)] = b
    return out.reshape(rows, HALF)


class ByteNet:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "e": r.normal(0, 0.5, (256, EMBED)).astype(f),
            "w": r.normal(0, 0.25, (2, STEP * EMBED, FILTERS)).astype(f),  # for the first and the last 4 of 8 bytes
            "c": np.zeros(FILTERS, f),
            "v": np.zeros(2 * FILTERS, f),
            "b": np.zeros(1, f),
        }

    def _conv(self, x: np.ndarray) -> np.ndarray:
        """Filter outputs before the rectifier at each step of consecutive bytes x (a multiple of STEP)."""
        e = self.p["e"][x].reshape(-1, STEP * EMBED)
        z = e @ self.p["w"][0] + self.p["c"]
        z[:-1] += (e @ self.p["w"][1])[1:]
        return z

    def vectors(self, text: str) -> np.ndarray:
        """Mean and maximum over all chunks of the text, a quarter of a million bytes at a time."""
        blocks = _blocks(text)
        if not len(blocks):
            return np.zeros(2 * FILTERS, np.float32)
        total, most, n, held = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), 0, None
        for a in range(0, len(blocks), 1024):
            part = blocks[a : a + 1025]  # one block more, for filters that reach into it
            z = self._conv(part.ravel()).reshape(len(part), _HALF_STEPS, FILTERS).max(1)[: min(1024, len(blocks) - a)]
            z = np.maximum(z, 0)
            z = z if held is None else np.concatenate([held, z])
            chunk = np.maximum(z[:-1], z[1:])
            total, n = total + chunk.sum(0), n + len(chunk)
            if len(chunk):
                most = np.maximum(most, chunk.max(0))
            held = z[-1:]
        return np.concatenate([total / n, most]).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.vectors(t) for t in texts], np.float32).reshape(-1, 2 * FILTERS)
        return 1 / (1 + np.exp(-(x @ self.p["v"] + self.p["b"]).astype(float)))

    def train(self, texts: list[str], labels: np.ndarray, epochs: int = 8, batch: int = 16, rate: float = 0.01, train_chunks: int = 12, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        docs = []
        for t, y in zip(texts, labels, strict=True):
            b = _blocks(t)
            if len(b) < 2:
                continue
            if len(b) > train_chunks + 1:  # runs of 3 blocks from all parts of the text
                at = np.unique(np.linspace(0, len(b) - 3, train_chunks // 2).astype(int))
                b = np.concatenate([b[i : i + 3] for i in at])
            docs.append((b, float(y)))
        if not docs:
            return
        share = np.mean([y for _, y in docs])
        self.p["b"][0] = np.log((share + 0.01) / (1.01 - share))
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for a in range(0, len(order), batch):
                grad = self._gradient([docs[i] for i in order[a : a + batch]])
                step += 1
                for k, g in grad.items():
                    m[k][0] += 0.1 * (g - m[k][0])
                    m[k][1] += 0.01 * (g * g - m[k][1])
                    self.p[k] -= rate * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.99**step)) + 1e-6)

    def _gradient(self, docs: list) -> dict[str, np.ndarray]:
        p = self.p
        x = np.concatenate([b for b, _ in docs]).ravel()
        e = p["e"][x].reshape(-1, STEP * EMBED)
        z = e @ p["w"][0] + p["c"]
        z[:-1] += (e @ p["w"][1])[1:]
        zb = z.reshape(-1, _HALF_STEPS, FILTERS)
        at = zb.argmax(1)
        top = np.maximum(np.take_along_axis(zb, at[:, None], 1)[:, 0], 0)
        d_top = np.zeros_like(top)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        row = 0
        for b, y in docs:
            t = top[row : row + len(b)]
            left = t[:-1] >= t[1:]
            chunk = np.where(left, t[:-1], t[1:])
            best = chunk.argmax(0)
            u = np.concatenate([chunk.mean(0), chunk.max(0)])
            d = (1 / (1 + np.exp(-float(u @ p["v"] + p["b"][0]))) - y) / len(docs)
            g["v"] += d * u
            g["b"] += d
            dc = np.broadcast_to(d * p["v"][:FILTERS] / len(chunk), chunk.shape).copy()
            dc[best, np.arange(FILTERS)] += d * p["v"][FILTERS:]
            d_top[row : row + len(b) - 1] += np.where(left, dc, 0)
            d_top[row + 1 : row + len(b)] += np.where(left, 0, dc)
            row += len(b)
        d_top *= top > 0
        g["v"] += 1e-4 * p["v"]
        block, f = np.nonzero(d_top)
        pos, d = block * _HALF_STEPS + at[block, f], d_top[block, f]
        dz = np.zeros_like(z)
        dz[pos, f] = d
        g["c"] = dz.sum(0)
        g["w"][0] = e.T @ dz
        g["w"][1] = e[1:].T @ dz[:-1]
        de = dz @ p["w"][0].T
        de[1:] += dz[:-1] @ p["w"][1].T
        hit = np.flatnonzero(np.abs(de).sum(1) > 0)
        np.add.at(g["e"], x.reshape(-1, STEP)[hit].ravel(), de[hit].reshape(-1, EMBED))
        return g


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1000, longest: int = 1_000_000) -> ByteNet:
    """Train on ``sample`` labelled rows outside the held-out fold, chosen by hash, of ``longest`` characters at most."""
    known = labels.filter(F.col("quality").isNotNull() & ~held_out(0, 5)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by the limit, so it may be broadcast
    got = docs.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= longest).join(F.broadcast(chosen), "doc_id")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * sample).toArrow().to_pandas()
    net = ByteNet()
    net.train([t or "" for t in got["text"]], got["y"].to_numpy())
    return net


def classify(docs: DataFrame, net: ByteNet, threshold: float = 0.3) -> DataFrame:
    """All columns of docs, with score (0 to 1) and predicted (1 if score >= threshold)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in common.leanly(batches):
            yield pd.Series(net.score([t or "" for t in batch]))

    s = F.col("__score")
    out = common.in_small_batches(docs).withColumn("__score", score.asNondeterministic()(F.col("text").cast("string")))
    return common.replace_columns(out, {"score": s, "predicted": (s >= threshold).cast("int")}).drop("__score")
