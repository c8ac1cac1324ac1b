"""Language ID in two levels: the family first, then one-versus-one linear support vector machines inside it.

A text becomes the square-rooted, normalised histogram of its hashed byte trigrams (lower case, letters of the whole
text). Families are told apart by one-versus-one machines too; a language of no listed family is a family by itself.
The machines are trained by dual coordinate ascent on at most ``per_language`` texts of each language.

Defined results: null texts and texts without a letter give ``und`` with score 0; so does every text if nothing could be
learned; rows with null lang teach nothing; ties of votes go to the greater margins, then to the first class by name;
repeated rows are judged one by one; an empty table gives no rows; columns named lang_pred or score give way, others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BUCKETS = 4096
#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "es fr it pt ro ca gl oc la",
    "slavic": "ru uk be bg sr hr bs sl sk cs pl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "indic": "hi ur bn pa gu mr ne si",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def features(texts: list[str]) -> np.ndarray:
    """One normalised row for each text, from all its bytes; digits, signs and blanks count as one blank."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        b = np.frombuffer(f" {t} ".lower().encode("utf-8", "surrogatepass"), np.uint8)
        b = _FOLD[b]
        code = (b[:-2].astype(np.uint32) * 65599 + b[1:-1].astype(np.uint32) * 257 + b[2:]) * np.uint32(2654435761)
        x = np.sqrt(np.bincount(code >> np.uint32(20), minlength=BUCKETS).astype(np.float32))
        out[i] = x / max(float(np.sqrt((x * x).sum())), 1e-9)
    return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Weights (bias last) of a linear machine with hinge loss, y = 1 or -1, by dual coordinate ascent."""
    r = np.random.default_rng(seed)
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1).astype(np.float64)
    square = (x * x).sum(1)
    a, w = np.zeros(len(x)), np.zeros(x.shape[1])
    for _ in range(rounds):
        for i in r.permutation(len(x)):
            new = min(max(a[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0), c)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


class Machines:
    """One-versus-one machines over some classes; margins decide ties of votes."""

    def __init__(self, classes: list[str], x: np.ndarray, y: np.ndarray):
        self.classes, self.pairs, w = classes, list(combinations(range(len(classes)), 2)), []
        for a, b in self.pairs:
            own = np.isin(y, [classes[a], classes[b]])
            w.append(train_svm(x[own], np.where(y[own] == classes[a], 1.0, -1.0)))
        self.w = np.array(w, np.float32).reshape(len(self.pairs), x.shape[1] + 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class and a score from 0 to 1: the logistic of its least margin."""
        n = len(x)
        if len(self.classes) == 1:
            return np.zeros(n, int), np.ones(n)
        m = x @ self.w[:, :-1].T + self.w[:, -1]
        votes, least = np.zeros((n, len(self.classes))), np.full((n, len(self.classes)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += (m[:, k] > 0) + 0.01 * np.tanh(m[:, k])
            votes[:, b] += (m[:, k] <= 0) - 0.01 * np.tanh(m[:, k])
            least[:, a] = np.minimum(least[:, a], m[:, k])
            least[:, b] = np.minimum(least[:, b], -m[:, k])
        best = votes.argmax(1)
        return best, 1 / (1 + np.exp(-2 * least[np.arange(n), best].astype(float)))


class Hierarchy:
    def __init__(self, texts: list[str], langs: list[str]):
        x, y = features(texts), np.array(langs, object)
        fam = np.array([family(v) for v in langs], object)
        self.families = sorted(set(fam))
        self.top = Machines(self.families, x, fam)
        self.inside = [Machines(sorted(set(y[fam == f])), x[fam == f], y[fam == f]) for f in self.families]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        rows = np.array([i for i, t in enumerate(texts) if t and _LETTER.search(t)], int)
        if not self.families or not len(rows):
            return lang, score
        x = features([texts[i] for i in rows])
        f, s = self.top.predict(x)
        for k, inner in enumerate(self.inside):
            own = np.flatnonzero(f == k)
            if len(own):
                c, t = inner.predict(x[own])
                score[rows[own]] = s[own] * t
                for i, v in zip(rows[own], c, strict=True):
                    lang[i] = inner.classes[v]
        return lang, score


def fit(docs: DataFrame, learn, per_language: int = 300, longest: int = 200_000, most_languages: int = 250) -> Hierarchy:
    """Train on rows where ``learn`` holds: of each of the ``most_languages`` most frequent languages the ``per_language``
    of the smallest hash (all rows of a language that has fewer), texts of at most ``longest`` characters.

    Languages are counted first; of a language with n rows, only those whose hash lies in the lowest 2 * per_language / n of
    the range (some twice as many as are wanted) are ranked, so no more texts than that are ever moved.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & (F.length("text") <= longest))
    rows = rows.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("__h"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    shares = [(r["lang"], min(int(-(2.0**63) + 2.0**64 * min(1.0, 2 * per_language / r["count"])), 2**63 - 1)) for r in counts]
    if not shares:
        return Hierarchy([], [])
    low = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, __most long"))  # most_languages rows at most
    rank = F.row_number().over(W.partitionBy("lang").orderBy("__h", "text"))
    got = rows.join(low, "lang").filter("__h <= __most").withColumn("__rn", rank).filter(F.col("__rn") <= per_language)
    got = got.orderBy("lang", "__rn").select("text", "lang").toArrow().to_pandas()
    return Hierarchy(got["text"].tolist(), got["lang"].tolist())


def identify(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """All columns of docs, with lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in common.leanly(batches):
            texts = [t or "" for t in batch]
            lang, score = [], []
            for a in range(0, len(texts), 256):
                x, s = model.predict(texts[a : a + 256])
                lang += x
                score += s.tolist()
            yield pd.DataFrame({"lang_pred": pd.Series(lang, dtype=object), "score": pd.Series(score, dtype=float)})

    p = F.col("__pred")
    out = common.in_small_batches(docs).withColumn("__pred", predict.asNondeterministic()(F.col("text").cast("string")))
    return common.replace_columns(out, {"lang_pred": p["lang_pred"], "score": p["score"]}).drop("__pred")
