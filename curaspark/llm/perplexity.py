"""Quality rules: counted features of a text, and a perplexity band under a modified Kneser-Ney model of its corpus.

The model's n-grams are ``ORDER`` bytes of UTF-8, no character folded. Spark counts those of all texts, none left out, so
that the tables grow with the corpus. A task hands on one block of counts for each shard; a shard holds all n-grams whose
fourth and fifth byte hash to it, and with them all their contexts and suffixes of three bytes and more, so that the
model is made shard by shard. N-grams of four bytes and more that were met once (``LEAST``) leave their mass to the
back-off, so that junk does not vouch for itself. A shard's probabilities and back-off weights stand in arrays sorted by
hashed n-gram, in a file of the shared folder; workers map the files, or read one shard at a time where the folder is no
local mount. What the driver holds is bounded: counts of counts, and the 65,536 pairs of bytes.

One pass judges all texts into a table in the shared folder; exact histograms of log perplexity by language are taken from
it. A band around each language's median, from ``lower`` to ``upper`` robust standard deviations and wider for short
texts, decides what is kept.

Defined results: a null or empty text has zero counts and fails the base rules; a null or unusual lang counts as
``und``; repeated rows are judged one by one; texts exactly at an end of the band are kept; an empty table gives no rows;
columns of docs that bear a result's name give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of an n-gram, and the shortest that a shard holds whole.
ORDER, LOCAL = 6, 3
#: Fewest times (below ORDER: different bytes before it) that an n-gram of so many bytes is met to have a probability of its own.
LEAST = {6: 2, 5: 2, 4: 2, 3: 1}
#: Stands before a text; no byte of UTF-8.
START = 0xFF
#: Distinct n-grams that a counting task holds before it adds them up, and hands them on if half of them are left.
HELD_GRAMS = 1_000_000
#: Bytes of text whose n-grams are counted or looked up at once.
PORTION = 500_000
#: Histogram of log perplexity: buckets a nat, and the most nats.
FINE, MOST_NATS = 128, 8
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_U = np.uint64


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram (a number of 48 bits, its last byte lowest) that ends at each byte of the joined texts; where each text
    begins and ends in it. What stands outside these bounds belongs to the starts and ends in START."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    pad = bytes([START]) * (ORDER - 1)
    data = pad + pad.join(coded) + pad + b"\0\0"
    wide = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    codes = wide.astype(np.uint64) >> _U(64 - 8 * ORDER)
    n = np.fromiter(map(len, coded), np.int64, len(coded))
    first = np.cumsum(n + ORDER - 1) - n - (ORDER - 1)
    return codes, first, first + n


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """By the fourth and fifth of six bytes; shards is a power of two, 2**16 at most."""
    middle = (codes >> _U(8)).astype(np.uint32) & np.uint32(0xFFFF)
    return (((middle + np.uint32(1)) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16) & np.uint16(shards - 1)


def _summed(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of several counts, and their sums."""
    code, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(code)])
    return code[head], np.add.reduceat(n, head) if len(head) else n


def _counted(sorted_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]])[: len(sorted_codes)])
    return sorted_codes[head], np.diff(np.append(head, len(sorted_codes)))


def text_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of the texts and how often each stands there."""
    codes, n = _counted(np.sort(gram_codes(texts)[0]))
    own = (codes & _U(0xFF)) != START
    return codes[own], n[own]


def count_grams(docs: DataFrame, shards: int) -> DataFrame:
    """shard, codes, n (little-endian arrays): counts of a shard's n-grams by a task. A task hands on its counts when it
    holds HELD_GRAMS of them."""

    def rows(held: list) -> Iterator[pd.DataFrame]:
        codes, n = _summed(held)
        which = shard_of(codes, shards)
        order = np.argsort(which, kind="stable")
        codes, n, bounds = codes[order], n[order], np.concatenate([[0], np.cumsum(np.bincount(which, minlength=shards))])
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[k], bounds[k + 1]
            yield pd.DataFrame({"shard": [k], "codes": [codes[a:b].tobytes()], "n": [n[a:b].astype(np.int64).tobytes()]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in common.leanly(batches):
            texts = [t for t in batch["text"] if t]
            for a, b in common.slices(texts, PORTION):
                held.append(text_counts(texts[a:b]))
                size += len(held[-1][0])
                if size > HELD_GRAMS:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > HELD_GRAMS // 2:
                        yield from rows(held)
                        held, size = [], 0
        if held:
            yield from rows(held)

    return docs.select(F.col("text").cast("string")).mapInPandas(count, "shard int, codes binary, n binary")


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more (Chen and Goodman 1998), bounded for small corpora."""
    if not n1 or not n2:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d[1:], 1))])


def _shorter(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``order`` bytes that end those one byte longer, and how many of these each ends."""
    return _counted(np.sort(codes & _U((1 << 8 * order) - 1)))


def shard_statistics(codes: np.ndarray, n: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Counts of counts for orders ORDER to LOCAL, one after the other; the pairs of bytes that end n-grams of LOCAL
    bytes, and how many of these each ends."""
    out = _counts_of_counts(n)
    for k in range(ORDER - 1, LOCAL - 1, -1):
        codes, n = _shorter(codes, k)
        out += _counts_of_counts(n)
    return (out, *_shorter(codes, LOCAL - 1))


class Base:
    """What all shards share: discounts by order, and the probabilities of pairs of bytes."""

    def __init__(self, counts_of_counts: list[int], pairs: np.ndarray, n: np.ndarray):
        self.discounts = {k: discounts(*counts_of_counts[4 * i : 4 * i + 4]) for i, k in enumerate(range(ORDER, LOCAL - 1, -1))}
        pairs = pairs.astype(np.int64)
        ones, n1 = _shorter(pairs.astype(np.uint64), 1)
        count = np.zeros((2, 1 << 16))
        count[1, pairs], count[0, ones.astype(np.int64)] = n, n1
        p = self._mixed(count[0, :256][None], np.full((1, 256), 1 / 256))
        self.log_pair = np.log(self._mixed(count[1].reshape(256, 256), p)).astype(np.float32).ravel()

    @staticmethod
    def _mixed(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Interpolated probabilities of each context (row); those of a context that was not met are the lower ones."""
        d = discounts(*_counts_of_counts(count))[np.minimum(count, 3).astype(int)]
        total = np.maximum(count.sum(1, keepdims=True), 1)
        rest = np.where(count.sum(1, keepdims=True) > 0, d.sum(1, keepdims=True) / total, 1.0)
        return (count - d) / total + rest * lower


def _keys(order: int, codes: np.ndarray) -> np.ndarray:
    return common.mix64(codes | _U(order << 56))


class Shard:
    """For each order k from LOCAL to ORDER: hashes of n-grams, sorted, where each of the equal parts of the range of
    hashes begins among them, and log probabilities; the same of contexts and log back-off weights."""

    KINDS = (np.uint64, np.int32, np.float32)

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays

    def table(self, order: int, contexts: bool) -> list[np.ndarray]:
        at = 6 * (order - LOCAL) + 3 * contexts
        return self.arrays[at : at + 3]

    @staticmethod
    def of(codes: np.ndarray, n: np.ndarray, base: Base) -> Shard:
        grams, counts = {ORDER: codes}, {ORDER: n}
        for k in range(ORDER - 1, LOCAL - 1, -1):
            grams[k], counts[k] = _shorter(grams[k + 1], k)
        out = []
        for k in range(LOCAL, ORDER + 1):
            g, c = grams[k], counts[k].astype(float)
            if k == LOCAL:
                lower = np.exp(base.log_pair[(g & _U(0xFFFF)).astype(np.int64)].astype(float))
            else:
                lower = p[np.searchsorted(grams[k - 1], g & _U((1 << 8 * (k - 1)) - 1))]  # noqa: F821  of the round before
            contexts, where = np.unique(g >> _U(8), return_inverse=True)
            total = np.bincount(where, c)
            own = c >= LEAST[k]
            taken = np.where(own, c - base.discounts[k][np.minimum(c, 3).astype(int)], 0) / total[where]
            rest = np.maximum(1 - np.bincount(where, taken), 1e-9)
            p = taken + rest[where] * lower
            for key, value in ((_keys(k, g[own]), p[own]), (_keys(k + 8, contexts), rest)):
                order = np.argsort(key)
                out += [key[order], _starts(key[order]), np.log(value[order]).astype(np.float32)]
        return Shard(out)

    def log_p(self, codes: np.ndarray, base: Base) -> np.ndarray:
        """Natural log probability of the last byte of each n-gram."""
        out, left, add = np.zeros(len(codes), np.float32), None, None
        for k in range(ORDER, LOCAL - 1, -1):
            keys, starts, values = self.table(k, contexts=False)
            mine = codes if left is None else codes[left] & _U((1 << 8 * k) - 1)
            hit, at = _find(keys, starts, _keys(k, mine))
            if left is None:
                if len(values):
                    np.copyto(out, values[at], where=hit)
                left = np.flatnonzero(~hit)
                add = np.zeros(len(left), np.float32)
                mine = codes[left]
            else:
                out[left[hit]] = values[at[hit]] + add[hit]
                left, add, mine = left[~hit], add[~hit], mine[~hit]
            if not len(left):
                return out
            keys, starts, rest = self.table(k, contexts=True)
            hit, at = _find(keys, starts, _keys(k + 8, mine >> _U(8)))
            add[hit] += rest[at[hit]]
        out[left] = base.log_pair[(codes[left] & _U(0xFFFF)).astype(np.int64)] + add
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(x) for x in self.arrays], np.int64).tobytes() + b"".join(x.tobytes() for x in self.arrays)

    @staticmethod
    def from_buffer(data) -> Shard:
        size, out = 6 * (ORDER - LOCAL + 1), []
        at = 8 * size
        for i, n in enumerate(np.frombuffer(data, np.int64, size).tolist()):
            out.append(np.frombuffer(data, Shard.KINDS[i % 3], n, at))
            at += out[-1].nbytes
        return Shard(out)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Place of the first key of each part; there are about twice as many parts as keys, a power of two."""
    bits = max(len(keys), 1).bit_length()
    return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits)).astype(np.int32)


def _find(keys: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each is among the sorted keys, and where. Hashes are spread evenly, so a part has few keys to step over."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    last = len(keys) - 1
    at = np.minimum(starts[wanted >> _U(65 - len(starts).bit_length())], last)
    found = keys[at]
    behind = np.flatnonzero((found < wanted) & (at < last))
    while len(behind):
        at[behind] += 1
        found[behind] = step = keys[at[behind]]
        behind = behind[(step < wanted[behind]) & (at[behind] < last)]
    return found == wanted, at


class Model:
    """A base and shards, given by number: in memory, or files of a folder."""

    def __init__(self, base: Base, shards: int, folder: str | None = None, held: dict[int, Shard] | None = None):
        self.base, self.shards, self.folder, self.held = base, shards, folder, held
        self._nothing = Shard([np.zeros(0, Shard.KINDS[i % 3]) for i in range(6 * (ORDER - LOCAL + 1))])

    @staticmethod
    def of(texts: list[str], shards: int = 1) -> Model:
        """The model of a few texts, in memory."""
        codes, n = text_counts(texts)
        which = shard_of(codes, shards)
        parts = {k: (codes[which == k], n[which == k]) for k in range(shards)}
        found = [shard_statistics(*x) for x in parts.values()]
        base = Base(np.sum([x[0] for x in found], 0).tolist(), *_summed([x[1:] for x in found]))
        return Model(base, shards, held={k: Shard.of(*x, base) for k, x in parts.items()})

    def shard(self, k: int) -> Shard:
        if self.held is not None:
            return self.held.get(k, self._nothing)
        data = _mapped(self.folder, k)
        return self._nothing if data is None else Shard.from_buffer(data)

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Looked up shard by shard, so that a shard is held for as long as it is needed."""
        which = shard_of(codes, self.shards)
        order = np.argsort(which, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=self.shards))]).tolist()
        dealt = codes[order]
        found = np.empty(len(codes), np.float32)
        for k in range(self.shards):
            a, b = bounds[k], bounds[k + 1]
            if a < b:
                found[a:b] = self.shard(k).log_p(dealt[a:b], self.base)
        out = np.empty(len(codes), np.float32)
        out[order] = found
        return out

    def perplexity(self, texts: list[str]) -> np.ndarray:
        """Log perplexity a byte of each text; 0 for empty ones."""
        out = np.zeros(len(texts))
        for a, b in common.slices(texts, PORTION):
            codes, first, last = gram_codes(texts[a:b])
            total = np.concatenate([[0.0], np.cumsum(self.log_p(codes), dtype=np.float64)])
            out[a:b] = (total[first] - total[last]) / np.maximum(last - first, 1)
        return out


#: The mapped shards of one model: a worker that gets to another model lets go of them.
_maps: dict[str, dict] = {}


def _mapped(folder: str, k: int):
    """A shard's bytes: mapped once by a worker, or read each time where the folder is no local mount."""
    if common.local_path(folder) is None:
        return common.read_file(f"{folder}/{k}")
    if folder not in _maps:
        _maps.clear()
        _maps[folder] = {}
    held = _maps[folder]
    if k not in held:
        held[k] = common.map_file(f"{folder}/{k}")
    return held[k]


def fit(docs: DataFrame, shards: int = 64) -> Model:
    """The model of all texts, in files of the shared folder. shards: a power of two; about a million distinct n-grams
    in each are few enough for a task's memory."""
    spark = docs.sparkSession
    kind = "shard int, codes binary, n binary, stats array<long>, pairs array<int>, pair_n array<long>"

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codes, n = _summed([(np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)) for a, b in zip(rows["codes"], rows["n"], strict=True)])
        stats, pairs, pair_n = shard_statistics(codes, n)
        return pd.DataFrame({"shard": [key[0]], "codes": [codes.tobytes()], "n": [n.tobytes()], "stats": [stats], "pairs": [pairs.astype(np.int32)], "pair_n": [pair_n]})

    merged = common.cut(count_grams(common.in_small_batches(docs), shards).groupBy("shard").applyInPandas(merge, kind))
    stats = merged.select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    pairs = merged.select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("x")).groupBy("x.pairs").agg(F.sum("x.pair_n").alias("n")).toArrow()  # 65,536 rows at most
    base = Base([r.v for r in stats] or [0] * 4 * (ORDER - LOCAL + 1), pairs["pairs"].to_numpy(), pairs["n"].to_numpy())
    folder = common.new_folder(spark, "ngrams")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                common.write_file(f"{folder}/{r.shard}", Shard.of(np.frombuffer(r.codes, np.uint64), np.frombuffer(r.n, np.int64), base).to_bytes())
                yield pd.DataFrame({"shard": [r.shard]})

    merged.select("shard", "codes", "n").mapInPandas(build, "shard int").count()
    common.drop(merged)
    return Model(base, shards, folder)


def base_features(texts: list[str]) -> pd.DataFrame:
    """Counts of the base rules; see the columns. All over whole texts."""
    w = common.Words(texts)
    n, rows = np.diff(w.bounds), len(texts)
    at = np.flatnonzero((w.bytes & 0xC0) == 0x80)  # bytes that begin no character; they stand in words alone
    inside = np.diff(np.searchsorted(at, w.byte_bounds))
    word_chars = (np.bincount(w.doc, w.end - w.start, rows) if len(w.doc) else np.zeros(rows)) - inside
    signs = np.searchsorted(np.flatnonzero(_IS_SYMBOL[w.bytes]), w.byte_bounds)
    h, first = w.windows(5)
    repeated = np.zeros(len(w.start) + 5, np.int64)
    if len(h):
        own = h ^ common.mix64(w.doc[first].astype(np.uint64))  # a window of another text is another one
        ordered = np.sort(own)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        at = first[twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own] if len(twice) else first[:0]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + 5, -1)
    covered = np.cumsum(repeated)[: len(w.start)] > 0
    dup = []
    for t in texts:
        lines = t.split("\n")
        if len(lines) > 1:
            lines = [x for x in lines if x.strip(" \t\n\v\f\r")]
            dup.append(len(lines) - len(set(lines)))
        else:
            dup.append(0)
    return pd.DataFrame(
        {
            "n_words": n.astype(np.int64),
            "word_chars": word_chars.astype(np.int64),
            "n_symbols": np.diff(signs).astype(np.int64),
            "n_dup_lines": np.array(dup, np.int64),
            "n_repeat_words": np.bincount(w.doc, covered, rows).astype(np.int64) if rows else np.zeros(0, np.int64),
        }
    )


def language(c: Column) -> Column:
    """Two or three letters (so there are at most 18,252 of them), else und."""
    return F.when(c.rlike("^[a-z]{2,3}$"), c).otherwise("und")


def lang_of(docs: DataFrame) -> Column:
    return language(F.col("lang").cast("string")) if "lang" in docs.columns else F.lit("und")


def bands(scored: DataFrame, least: float = 0.03) -> dict[str, tuple[float, float]]:
    """lang -> (median, robust standard deviation) of log_ppl, from exact histograms over all texts that have a character."""
    b = F.least(F.floor(F.col("log_ppl") * FINE), F.lit(FINE * MOST_NATS - 1)).cast("int")
    got = scored.filter("__chars > 0").groupBy(F.col("__lang").alias("l"), b.alias("b")).count().toArrow().to_pandas()
    out = {}
    for lang, g in got.groupby("l"):
        mid = _weighted_median(g["b"].to_numpy() + 0.5, g["count"].to_numpy())
        off = _weighted_median(np.abs(g["b"].to_numpy() + 0.5 - mid), g["count"].to_numpy())
        out[lang] = (mid / FINE, max(1.4826 * off / FINE, least))
    return out


def _weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    total = np.cumsum(w[order])
    return float(x[order][np.searchsorted(total, total[-1] / 2)])


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the features of its texts and their log perplexity."""

    @F.pandas_udf(FEATURES)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in common.leanly(batches):
            texts = [t or "" for t in text]
            parts = [base_features(texts[a:b]).assign(log_ppl=model.perplexity(texts[a:b])) for a, b in common.slices(texts, PORTION)]
            yield pd.concat(parts, ignore_index=True) if parts else base_features([]).assign(log_ppl=0.0)

    x = F.col("__judged")
    out = common.in_small_batches(docs).withColumn("__judged", read.asNondeterministic()(F.col("text").cast("string")))
    return common.replace_columns(out, {f.split()[0]: x[f.split()[0]] for f in FEATURES.split(", ")}).drop("__judged")


def quality_rules(docs: DataFrame, lower: float = 6.0, upper: float = 5.0, short_chars: int = 200, with_text: bool = True) -> DataFrame:
    """All columns of docs, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ppl, base_failed, kept.

    The band grows by sqrt(1 + short_chars / length), as means over few characters vary more. with_text: whether the text
    is among the columns; without it, the table that is written between has no texts.
    """
    spark = docs.sparkSession
    model = fit(docs)
    named = docs.withColumns({"__lang": lang_of(docs), "__chars": F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))})
    scored = judge(named, model)
    scored = common.stash(scored if with_text else scored.drop("text"), "judged")
    common.remove(spark, model.folder)
    limits = bands(scored)
    rows = [(lang, mid, sd) for lang, (mid, sd) in limits.items()]  # 18,253 at most, see language()
    band = F.broadcast(spark.createDataFrame(rows, "__lang string, __mid double, __sd double"))
    off = (F.col("log_ppl") - F.col("__mid")) / (F.col("__sd") * F.sqrt(1 + short_chars / F.greatest("__chars", F.lit(1))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & F.coalesce(off.between(-lower, upper), F.lit(False))
    out = scored.join(band, "__lang", "left")
    return common.replace_columns(out, {"base_failed": failed, "kept": kept}).drop("__lang", "__chars", "__mid", "__sd")
