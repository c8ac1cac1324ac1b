"""Linear probes, repeated nested cross-validation, k-means, silhouette, projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions.scalar import training_relation

from .contracts import ContractError, c_grid, complete_classes, refuse
from .evaluation import fold_assignment

PREDICTIONS = "embedding_row long, sample_id string, mode string, class_name string, training_domain string, true_class string, predicted_class string"
METRICS = "training_domain string, evaluation_mode string, selected_c double, validation_macro_f1 double, accuracy double, balanced_accuracy double, macro_f1 double, fit_samples long, test_samples long"
FOLDS = "outer_repeat int, outer_fold int, training_domain string, evaluation_mode string, selected_c double, inner_validation_macro_f1 double, accuracy double, balanced_accuracy double, macro_f1 double, fit_samples long, evaluation_samples long"
#: Rows that one fit may take into a task, as a matrix of their own type (256 bytes for 64 floats); more go to the distributed
#: solver.
LOCAL_ROWS = 1_000_000
CHUNK = 2048


class Softmax:
    """Multinomial logistic regression, 0.5 |w|^2 + C * log loss, free intercepts, by Newton steps in numpy. Rows are made
    doubles chunk by chunk; second derivatives, which cost most, are taken anew only when steps by the old ones gain little."""

    def __init__(self, c: float, steps: int = 300, tol: float = 1e-8):
        self.c, self.steps, self.tol = c, steps, tol

    def fit(self, x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, at: np.ndarray | None = None) -> Softmax:
        """start: weights of a fit of the same classes, to begin with; there is one optimum. at: the rows to fit on; none: all."""
        at = np.arange(len(y)) if at is None else at
        self.classes, t = np.unique(y[at], return_inverse=True)
        k, d = len(self.classes), x.shape[1]
        w = np.zeros((d + 1, k)) if start is None else start
        ridge = np.concatenate([np.ones(d), [0.0]])

        def chunks(w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            for a in range(0, len(at), CHUNK):
                i = at[a : a + CHUNK]
                x1 = np.ones((len(i), d + 1))
                x1[:, :d] = x[i]
                z = x1 @ w
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                s = p.sum(1, keepdims=True)
                p /= s
                yield x1, t[a : a + CHUNK], z - np.log(s), p

        def slope(w: np.ndarray) -> tuple[float, np.ndarray]:
            loss, g = 0.5 * float((ridge[:, None] * w * w).sum()), ridge[:, None] * w
            for x1, own, logs, p in chunks(w):
                r = np.arange(len(own))
                loss -= self.c * float(logs[r, own].sum())
                p[r, own] -= 1
                g += self.c * (x1.T @ p)
            return loss, g

        def curve(w: np.ndarray) -> np.ndarray:
            h = np.zeros((k, d + 1, k, d + 1))
            for x1, _, _, p in chunks(w):
                for a in range(k):
                    for b in range(a + 1, k):
                        v = x1 * np.sqrt(self.c * p[:, a] * p[:, b])[:, None]
                        h[a, :, b] -= v.T @ v
            for a in range(k):
                for b in range(a):
                    h[a, :, b] = h[b, :, a]
            for a in range(k):
                h[a, :, a] = -h[a].sum(1)
            h = h.reshape(k * (d + 1), -1)
            h[np.diag_indices_from(h)] += np.tile(ridge, k) + 1e-9
            return h

        (now, g), h, fresh = slope(w), None, False
        for _ in range(self.steps):
            size = np.abs(g).max()
            if size < self.tol * max(1.0, self.c):
                break
            if h is None:
                h, fresh = curve(w), True
            step = np.linalg.solve(h, g.T.ravel()).reshape(k, d + 1).T
            rate = 1.0
            while rate > 1e-6 and (got := slope(w - rate * step))[0] > now + 1e-12 * (1 + abs(now)):
                rate = rate / 2 if fresh else 0.0
            if rate <= 1e-6:
                if fresh:
                    break
                h = None
                continue
            w, (now, g) = w - rate * step, got
            h, fresh = (h, False) if np.abs(g).max() < 0.2 * size else (None, False)
        self.w = w
        return self

    def predict(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(x)) if at is None else at
        parts = [(x[at[a : a + CHUNK]] @ self.w[:-1] + self.w[-1]).argmax(1) for a in range(0, len(at), CHUNK)]
        return self.classes[np.concatenate([np.zeros(0, int), *parts])]


def path_guesses(grid: list[float], x: np.ndarray, y: np.ndarray, fit: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """Classes of the rows in other by a fit on those in fit for each C, ascending; each fit begins at the one before."""
    out, w = [], None
    for c in grid:
        model = Softmax(c).fit(x, y, w, fit)
        w = model.w
        out.append(model.predict(x, other))
    return out


def scores(true: np.ndarray, guess: np.ndarray) -> tuple[float, float, float]:
    """accuracy, balanced accuracy, macro F1."""
    f1, recall = [], []
    for c in np.unique(np.concatenate([true, guess])):
        tp, t, p = ((true == c) & (guess == c)).sum(), (true == c).sum(), (guess == c).sum()
        f1.append(2 * tp / (t + p) if t + p else 0.0)
        if t:
            recall.append(tp / t)
    return float((true == guess).mean()), float(np.mean(recall)), float(np.mean(f1))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow column as a matrix; halves, floats and doubles as they are."""
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False)
    if column.null_count or flat.null_count or len(set(pc.list_value_length(column).unique().to_pylist())) > 1 or not np.isfinite(x).all():
        raise ContractError("embeddings must be finite and of one length")
    return x.reshape(len(column), -1)


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """Columns of a group as arrays, embedding as one matrix."""
    parts: dict[str, list] = {}
    for b in batches:
        if b.num_rows:
            for c in b.schema.names:
                # copied, so that no batch stays
                parts.setdefault(c, []).append(np.array(_matrix(b[c]) if c == "embedding" else b[c].to_numpy(zero_copy_only=False)))
    if len({x.shape[1] for x in parts["embedding"]}) > 1:
        raise ContractError("embeddings must be finite and of one length")
    return {c: np.concatenate(parts.pop(c)) for c in list(parts)}


def _codes(index: DataFrame, column: str) -> tuple[list[str], Column]:
    """The distinct values in order, and each row's place among them."""
    names = sorted(r[0] for r in index.select(column).distinct().collect())
    return names, (F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)) - 1).cast("int")


def domains(index: DataFrame) -> DataFrame:
    """Every row once for each training domain that its mode belongs to: each mode alone, and both."""
    modes = sorted(r[0] for r in index.select("mode").distinct().limit(3).collect())
    if len(modes) != 2:
        raise ContractError("exactly two modes are needed")
    both = "+".join(modes)
    return index.withColumn("training_domain", F.explode(F.array(F.col("mode"), F.lit(both))))


def probe_scenarios(index: DataFrame) -> DataFrame:
    """Rows to fit on (split train, val) by training domain, and the test rows of both modes for each domain."""
    fit = domains(index.filter(F.col("split").isin("train", "val"))).withColumn("role", F.col("split"))
    names = fit.select("training_domain").distinct()
    test = index.filter(F.col("split") == "test").join(F.broadcast(names.limit(3)), how="cross").withColumn("role", F.lit("test"))
    return fit.unionByName(test.select(fit.columns))


def linear_probes(index: DataFrame, c_values, local_rows: int = LOCAL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Metrics and predictions of three training domains on both modes: C is chosen on val (smallest of the best), the model
    is fitted again on train and val and used on test once. Every class must stand in each split of each mode."""
    grid = c_grid(c_values)
    complete_classes(index.filter(F.col("split").isin("train", "val", "test")))
    rows = probe_scenarios(index).select("training_domain", "role", "embedding_row", "sample_id", "mode", "class_name", "embedding")
    fit_rows, test = rows.filter("role <> 'test'"), rows.filter("role = 'test'")
    most = fit_rows.groupBy("training_domain").count().agg(F.max("count")).first()[0] or 0
    if most > local_rows:
        return _distributed_probes(index, grid)
    names, code = _codes(fit_rows, "class_name")

    def run(key: tuple[pa.Scalar], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gathered(batches)
        order = np.argsort(got["embedding_row"], kind="stable")
        x, y, train = got["embedding"], got["y"], got["train"][order]
        train, val = order[train], order[~train]
        tried = [(scores(y[val], guess)[2], -c) for c, guess in zip(grid, path_guesses(grid, x, y, train, val), strict=True)]
        best, less = max(tried)
        model = Softmax(-less).fit(x, y)
        yield pa.RecordBatch.from_pydict({"training_domain": [key[0].as_py()], "w": [model.w.tobytes()], "selected_c": [-less], "validation_macro_f1": [best], "fit_samples": [len(y)]})

    slim = fit_rows.select("training_domain", "embedding_row", (F.col("role") == "train").alias("train"), code.alias("y"), "embedding")
    fits = slim.groupBy("training_domain").applyInArrow(run, "training_domain string, w binary, selected_c double, validation_macro_f1 double, fit_samples long").collect()
    models = {r["training_domain"]: (np.frombuffer(r["w"]).reshape(-1, len(names)), r["selected_c"], r["validation_macro_f1"], r["fit_samples"]) for r in fits}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, domain = _matrix(b["embedding"]), b["training_domain"].to_pylist()
                guess = np.zeros(len(x), int)
                for d in set(domain):
                    own, w = np.array([v == d for v in domain]), models[d][0]
                    guess[own] = (x[own] @ w[:-1] + w[-1]).argmax(1)
                about = [pa.array([models[d][i] for d in domain]) for i in (1, 2, 3)]
                out = [*[b[c] for c in ("embedding_row", "sample_id", "mode", "class_name", "training_domain")], b["class_name"], pa.array([names[g] for g in guess]), *about]
                yield pa.RecordBatch.from_arrays(out, names=[*[c.split()[0] for c in PREDICTIONS.split(", ")], "selected_c", "validation_macro_f1", "fit_samples"])

    return _probe_tables(test.drop("role").mapInArrow(judge, PREDICTIONS + ", selected_c double, validation_macro_f1 double, fit_samples long"))


def _probe_tables(got: DataFrame) -> tuple[DataFrame, DataFrame]:
    from .evaluation import probe_metrics

    chosen = got.groupBy("training_domain").agg(F.first("selected_c").alias("selected_c"), F.first("validation_macro_f1").alias("validation_macro_f1"), F.first("fit_samples").alias("fit_samples"))
    m = probe_metrics(got.withColumnRenamed("mode", "evaluation_mode"), ["training_domain", "evaluation_mode"]).join(chosen, "training_domain")
    m = m.withColumn("relation", training_relation("training_domain", "evaluation_mode")).withColumnRenamed("samples", "test_samples")
    names = [c.split()[0] for c in METRICS.split(", ")]
    return m.select(*names[:2], "relation", *names[2:]).orderBy("training_domain", "evaluation_mode"), got.select(*[c.split()[0] for c in PREDICTIONS.split(", ")]).orderBy("training_domain", "mode", "sample_id")


def _coded(index: DataFrame):
    """The coder of class names, and index with y and x as pyspark.ml wants them."""
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    coder = StringIndexer(inputCol="class_name", outputCol="y", stringOrderType="alphabetAsc").fit(index)
    return coder, coder.transform(index).withColumn("x", array_to_vector(F.col("embedding").cast("array<double>")))


def _fitted(rows: DataFrame, c: float):
    """A multinomial logistic regression and its number of rows; the library's penalty is 1 / (C n)."""
    from pyspark.ml.classification import LogisticRegression

    n = rows.count()
    solver = LogisticRegression(featuresCol="x", labelCol="y", predictionCol="guess", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=5000)
    return solver.fit(rows), n


def _distributed_probes(index: DataFrame, grid: list[float]) -> tuple[DataFrame, DataFrame]:
    """The same by pyspark.ml."""
    from pyspark.ml.feature import IndexToString

    from .evaluation import probe_metrics

    coder, data = _coded(index)
    fit_rows, out = domains(data.filter(F.col("split").isin("train", "val"))), None

    name = IndexToString(inputCol="guess", outputCol="predicted_class", labels=coder.labels)
    for domain in sorted(r[0] for r in fit_rows.select("training_domain").distinct().limit(3).collect()):
        own = fit_rows.filter(F.col("training_domain") == domain)
        train, val = (own.filter(F.col("split") == s) for s in ("train", "val"))
        tried = []
        for c in grid:
            p = name.transform(_fitted(train, c)[0].transform(val)).withColumn("true_class", F.col("class_name"))
            tried.append((probe_metrics(p, []).first()["macro_f1"], -c))
        best, less = max(tried)
        fitted, n = _fitted(own, -less)
        p = name.transform(fitted.transform(data.filter(F.col("split") == "test")))
        p = p.select("embedding_row", "sample_id", "mode", "class_name", F.lit(domain).alias("training_domain"), F.col("class_name").alias("true_class"), "predicted_class", F.lit(-less).alias("selected_c"), F.lit(best).alias("validation_macro_f1"), F.lit(n).cast("long").alias("fit_samples"))
        out = p if out is None else out.unionByName(p)
    return _probe_tables(out)


def repeated_probes(index: DataFrame, c_values, outer: int = 5, repeats: int = 5, inner: int = 3, seed: int = 42, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """One row for each run, training domain and evaluation mode of nested cross-validation on train and val rows alone."""
    grid = c_grid(c_values)
    from .contracts import fold_feasibility

    dev = index.filter(F.col("split").isin("train", "val"))
    refuse(fold_feasibility(dev, outer, inner).filter("not feasible"), "folds cannot hold every class")
    lost = dev.select("class_name").distinct().join(dev.select("mode").distinct(), how="cross").join(dev, ["mode", "class_name"], "left_anti")
    refuse(lost, "classes missing in")
    if dev.count() > local_rows:
        return _distributed_repeats(dev, grid, outer, repeats, inner, seed)
    dealt = fold_assignment(dev, outer, repeats, seed).select("repeat", "fold", "embedding_row", "sample_id", "mode", "class_name", "embedding")
    runs = domains(dealt).withColumn("own", F.lit(True)).unionByName(_others(dealt))
    runs = runs.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).filter("own or fold = outer_fold")

    modes, mode_code = _codes(dev, "mode")
    slim = runs.select("repeat", "outer_fold", "training_domain", "own", "fold", "embedding_row", mode_code.alias("mode"), _codes(dev, "class_name")[1].alias("y"), "embedding")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gathered(batch.drop_columns(["repeat", "outer_fold", "training_domain"]) for batch in batches)
        repeat, k, domain = (v.as_py() for v in key)
        x, y, mode = got["embedding"], got["y"], got["mode"]
        order = np.lexsort((got["embedding_row"], mode))
        fit, held = (order[v[order]] for v in (got["own"] & (got["fold"] != k), got["fold"] == k))
        yf = y[fit]
        r = np.random.default_rng(seed + (repeat * outer + k) * 101)
        part = np.zeros(len(yf), int)
        at = 0
        for c in np.unique(yf):
            own = r.permutation(np.flatnonzero(yf == c))
            part[own] = (at + np.arange(len(own))) % inner
            at += len(own)
        paths = [path_guesses(grid, x, y, fit[part != j], fit[part == j]) for j in range(inner)]
        tried = [(float(np.mean([scores(yf[part == j], paths[j][i])[2] for j in range(inner)])), -c) for i, c in enumerate(grid)]
        best, less = max(tried)
        model, out = Softmax(-less).fit(x, y, at=fit), []
        for e in np.unique(mode[held]):
            s = held[mode[held] == e]
            out.append((repeat + 1, k + 1, domain, modes[e], -less, best, *scores(y[s], model.predict(x, s)), len(fit), len(s)))
        names = [c.split()[0] for c in FOLDS.split(", ")]
        table = {c: [row[i] for row in out] for i, c in enumerate(names)}
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c in names[:2] else None) for c, v in table.items()], names=names)

    got = slim.groupBy("repeat", "outer_fold", "training_domain").applyInArrow(run, FOLDS)
    return got.withColumn("relation", training_relation("training_domain", "evaluation_mode")).orderBy("training_domain", "evaluation_mode", "outer_repeat", "outer_fold")


def _distributed_repeats(dev: DataFrame, grid: list[float], outer: int, repeats: int, inner: int, seed: int) -> DataFrame:
    """The same by pyspark.ml, one fit after the other over all rows. Inner folds are dealt by hash like the outer ones."""
    from pyspark.ml.feature import IndexToString

    from .evaluation import probe_metrics

    coder, data = _coded(dev)
    name = IndexToString(inputCol="guess", outputCol="predicted_class", labels=coder.labels)
    dealt, out = domains(fold_assignment(data, outer, repeats, seed)), []

    def judged(model, rows: DataFrame, groups: list[str]) -> DataFrame:
        return probe_metrics(name.transform(model.transform(rows)).withColumn("true_class", F.col("class_name")), groups)

    names = sorted(r[0] for r in dealt.select("training_domain").distinct().limit(3).collect())
    for repeat in range(repeats):
        for fold in range(outer):
            held = dealt.filter((F.col("repeat") == repeat) & (F.col("fold") == fold)).dropDuplicates(["embedding_row"])
            for domain in names:
                own = dealt.filter((F.col("repeat") == repeat) & (F.col("fold") != fold) & (F.col("training_domain") == domain)).drop("repeat", "fold")
                parts = fold_assignment(own.withColumn("all", F.lit(1)), inner, 1, seed + (repeat * outer + fold) * 101, "all").drop("repeat")
                tried = []
                for c in grid:
                    got = [judged(_fitted(parts.filter(F.col("fold") != j), c)[0], parts.filter(F.col("fold") == j), []).first()["macro_f1"] for j in range(inner)]
                    tried.append((float(np.mean(got)), -c))
                best, less = max(tried)
                model, n = _fitted(own, -less)
                for r in judged(model, held, ["mode"]).collect():
                    out.append((repeat + 1, fold + 1, domain, r["mode"], -less, best, r["accuracy"], r["balanced_accuracy"], r["macro_f1"], n, r["samples"]))
    got = dev.sparkSession.createDataFrame(out, FOLDS)
    return got.withColumn("relation", training_relation("training_domain", "evaluation_mode")).orderBy("training_domain", "evaluation_mode", "outer_repeat", "outer_fold")


def _others(dealt: DataFrame) -> DataFrame:
    """Rows of the mode that a single-mode domain is only evaluated on."""
    modes = sorted(r[0] for r in dealt.select("mode").distinct().limit(3).collect())
    other = F.when(F.col("mode") == modes[0], modes[1]).otherwise(modes[0])
    return dealt.withColumn("training_domain", other).withColumn("own", F.lit(False))


def kmeans(index: DataFrame, k: int, seeds: int = 50, seed: int = 42, most: int = 300, tol: float = 1e-4, sample: int = 20_000) -> DataFrame:
    """index with kmeans_cluster: the fit of least cost over so many starts.

    All starts move at once: a round is one pass over the rows, which are kept as matrices dealt over all cores; a task adds up
    its rows by start and cluster. The first centres are drawn by distance (k-means++) from the ``sample`` rows of the smallest hash; all else is of all rows.
    A start rests when its centres move less than ``tol`` times the mean variance.
    """
    x = F.col("embedding").cast("array<double>")
    rows = index.select("embedding_row", x.alias("x")).filter("x is not null")
    cores = index.sparkSession.sparkContext.defaultParallelism
    packed = _packed(rows.repartition(max(1, min(2 * cores, -(-rows.count() // 4096))), "embedding_row")).persist()
    try:
        pool = rows.orderBy(F.xxhash64("embedding_row", "x")).limit(sample).select("x").toArrow()["x"].to_pylist()
        points = np.array(pool, float)
        if len(np.unique(points, axis=0)) < k:
            raise ContractError(f"fewer than {k} different rows")
        centres = np.array([_first_centres(points, k, np.random.default_rng(seed + s)) for s in range(seeds)])
        least = tol * float(points.var(0).mean())
        active, cost = list(range(seeds)), np.full(seeds, np.inf)
        for _ in range(most):
            sums, count, cost[active] = _kmeans_round(packed, centres[active])
            moved = np.where(count[:, :, None] > 0, sums / np.maximum(count, 1)[:, :, None], centres[active])
            shift = ((moved - centres[active]) ** 2).sum((1, 2))
            centres[active] = moved
            active = [s for s, d in zip(active, shift, strict=True) if d > least]
            if not active:
                break
        best = centres[int(np.argmin(_kmeans_round(packed, centres)[2]))]
    finally:
        packed.unpersist()

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            m = np.array(batch.tolist(), float)
            yield pd.Series((((best**2).sum(1) - 2 * m @ best.T).argmin(1) if len(m) else np.zeros(0)).astype(np.int32))

    return index.withColumn("kmeans_cluster", nearest(x))


def _first_centres(points: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    out = [points[r.integers(len(points))]]
    away = ((points - out[0]) ** 2).sum(1)
    while len(out) < k:
        out.append(points[r.choice(len(points), p=away / away.sum())])
        away = np.minimum(away, ((points - out[-1]) ** 2).sum(1))
    return np.array(out)


def _packed(rows: DataFrame) -> DataFrame:
    """x (doubles) of the rows as binary matrices, one for each batch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()])], names=["x"])

    return rows.select("x").mapInArrow(pack, "x binary")


def _kmeans_round(packed: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and numbers of the rows nearest to each centre (by start and cluster), and the cost of each start."""
    starts, k, dim = centres.shape
    flat = np.ascontiguousarray(centres.transpose(1, 0, 2)).reshape(-1, dim)  # cluster by cluster, each of all starts

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros((k * starts, dim + 2)), (flat**2).sum(1)
        for whole in (np.frombuffer(v.as_buffer()).reshape(-1, dim) for b in batches for v in b["x"]):
            for a in range(0, len(whole), 1024):
                x = whole[a : a + 1024]
                d = square - 2 * x @ flat.T
                near, at = d[:, :starts].copy(), np.zeros((len(x), starts), np.int32)
                for c in range(1, k):
                    one = d[:, c * starts : (c + 1) * starts]
                    at[one < near] = c
                    np.minimum(near, one, out=near)
                near = np.maximum(near + (x**2).sum(1)[:, None], 0)
                for c in range(k):
                    own, e = (at == c).astype(float), slice(c * starts, (c + 1) * starts)
                    total[e, :dim] += own.T @ x
                    total[e, dim] += own.sum(0)
                    total[e, dim + 1] += (own * near).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

    total = np.zeros(k * starts * (dim + 2))
    for v in packed.mapInArrow(add, "v binary").toArrow()["v"]:
        total += np.frombuffer(v.as_buffer())
    total = total.reshape(k, starts, dim + 2).transpose(1, 0, 2)
    return total[:, :, :dim], total[:, :, dim], total[:, :, dim + 1].sum(1)


def silhouette(rows: DataFrame, cluster: str, block: int = 32_768) -> DataFrame:
    """embedding_row, cluster and exact Euclidean silhouette of every row (0 for one alone in its cluster, or without a cluster
    or vector; the latter are nobody's neighbours).

    All distances are needed, so the work grows with the square of the rows: strips of at most ``block`` rows, packed as
    matrices, meet once in each order-free pair, whose distances serve the rows of both. A task holds two strips and its sums.
    """
    data = rows.select("embedding_row", F.col(cluster).cast("int").alias("cluster"), "embedding")
    whole = F.col("cluster").isNotNull() & F.col("embedding").isNotNull()
    about = data.filter(whole).groupBy("cluster").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).orderBy("cluster").collect()
    rest = data.filter(~whole).select("embedding_row", "cluster", F.lit(0.0).alias("silhouette"))
    if not about:
        return rest
    dim, labels, sizes = max(1, about[0]["hi"]), np.array([r["cluster"] for r in about], np.int32), np.array([r["n"] for r in about])
    if {r["lo"] for r in about} | {r["hi"] for r in about} != {about[0]["hi"]}:
        raise ContractError("embeddings must be of one length")
    n, k = int(sizes.sum()), len(labels)
    strip = max(1, min(block, -(-n // 8) if n > 4096 else n, (1 << 21) // dim, max(2048, (1 << 22) // k)))
    strips, piece = -(-n // strip), max(1, (1 << 17) // k)
    parts = data.filter(whole).withColumn("strip", F.pmod(F.xxhash64("embedding_row"), F.lit(strips)).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        code = np.searchsorted(labels, t["cluster"].to_numpy()).astype(np.int32)
        order = np.argsort(code, kind="stable")
        x = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(code), -1)[order]
        ids = t["embedding_row"].to_numpy()[order].astype(np.int64)
        return pa.table({"strip": t["strip"][:1], "ids": [ids.tobytes()], "codes": [code[order].tobytes()], "x": [x.astype(np.float64 if x.dtype != np.float32 else x.dtype).tobytes()], "wide": [x.dtype != np.float32]})

    packed = parts.groupBy("strip").applyInArrow(pack, "strip int, ids binary, codes binary, x binary, wide boolean")
    other = F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))
    tiles = packed.withColumn("other", other).select(F.least("strip", "other").alias("i"), F.greatest("strip", "other").alias("j"), "strip", "ids", "codes", "x", "wide")

    def meet(t: pa.Table) -> pa.Table:
        sides = sorted(({c: t[c][r].as_py() if c == "strip" else t[c][r] for c in t.column_names} for r in range(t.num_rows)), key=lambda s: s["strip"])
        xs = [np.frombuffer(s["x"].as_buffer(), np.float64 if s["wide"].as_py() else np.float32).reshape(-1, dim) for s in sides]
        codes = [np.frombuffer(s["codes"].as_buffer(), np.int32) for s in sides]
        twice = len(sides) == 2
        alone = t["i"][0].as_py() != t["j"][0].as_py() and not twice  # the other strip has no rows
        out = []
        if not alone:
            sums = _tile_sums(xs[0], codes[0], xs[-1], codes[-1], twice)
            for s, (columns, v) in zip(sides, sums, strict=False):
                ids = np.frombuffer(s["ids"].as_buffer(), np.int64)
                own = np.frombuffer(s["codes"].as_buffer(), np.int32)
                for a in range(0, len(v), piece):
                    e = slice(a, a + piece)
                    out.append((s["strip"], a // piece, None if twice else ids[e].tobytes(), None if twice else own[e].tobytes(), columns.astype(np.int32).tobytes(), v[e].tobytes()))
        names = ["strip", "piece", "ids", "codes", "columns", "sums"]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({c: pa.array([r[i] for r in out], kinds[i]) for i, c in enumerate(names)})

    many = min(2 * strips * strips, 4000) if strips > 1 else 1
    sums = tiles.repartition(many, "i", "j").groupBy("i", "j").applyInArrow(meet, "strip int, piece int, ids binary, codes binary, columns binary, sums binary")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ids, own = None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                columns, v = np.frombuffer(batch["columns"][r].as_buffer(), np.int32), np.frombuffer(batch["sums"][r].as_buffer())
                v = v.reshape(-1, len(columns))
                total = np.zeros((len(v), k)) if total is None else total
                total[:, columns] += v
                if batch["ids"][r].is_valid:
                    ids, own = (np.frombuffer(batch[c][r].as_py(), kind) for c, kind in (("ids", np.int64), ("codes", np.int32)))
        with np.errstate(divide="ignore", invalid="ignore"):
            a = total[np.arange(len(own)), own] / (sizes[own] - 1)
            total /= sizes
            total[np.arange(len(own)), own] = np.inf
            b = total.min(1)
            s = (b - a) / np.maximum(a, b)
        s[(sizes[own] == 1) | (k == 1) | (np.maximum(a, b) == 0)] = 0.0
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels[own]), pa.array(s)], names=["embedding_row", "cluster", "silhouette"])

    found = sums.groupBy("strip", "piece").applyInArrow(judge, "embedding_row long, cluster int, silhouette double")
    return found.unionByName(rest)


def _tile_sums(x: np.ndarray, cx: np.ndarray, y: np.ndarray, cy: np.ndarray, twice: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Clusters of y and each x's sums of distances to them; if twice, the same with sides changed. Both are in the order of
    their clusters. Distances come of a matrix product; where it would cancel, of the components."""
    (ux, kx), (uy, ky) = (np.unique(c, return_inverse=True) for c in (cx, cy))
    shift = x.mean(0, dtype=float)
    shift = shift if np.isfinite(shift).all() else np.zeros_like(shift)
    sx, sy = np.zeros((len(x), len(uy))), np.zeros((len(y), len(ux)) if twice else (0, 0))
    columns, same = [], None
    for b in range(0, len(y), 1024):
        v = y[b : b + 1024] - shift
        square = (v * v).sum(1)
        columns.append((np.ascontiguousarray(np.concatenate([v, np.ones((len(v), 1)), square[:, None]], 1).T), square.max()))
    for a in range(0, len(x), 256):
        u = x[a : a + 256] - shift
        square = (u * u).sum(1)
        left, most = np.concatenate([-2 * u, square[:, None], np.ones((len(u), 1))], 1), square.max()
        for b, (right, top) in zip(range(0, len(y), 1024), columns, strict=True):
            if np.isfinite(most + top):
                d = left @ right
                close = np.flatnonzero(d.ravel() < 1e-6 * (most + top))
                i, j = close // d.shape[1], close % d.shape[1]
                d.ravel()[close] = 0.0
                if len(close) > 4096:  # many copies: only pairs that differ are measured
                    if same is None:
                        same = np.unique(np.ascontiguousarray(np.concatenate([x, y])), axis=0, return_inverse=True)[1].ravel()
                    i, j = (q[same[a + i] != same[len(x) + b + j]] for q in (i, j))
                for e in range(0, len(i), 65_536):
                    p, q = i[e : e + 65_536], j[e : e + 65_536]
                    d[p, q] = ((x[a + p].astype(float) - y[b + q]) ** 2).sum(1)
                np.sqrt(d, out=d)
            else:
                d = _distances(x[a : a + 256].astype(float), y[b : b + 1024])
            _add(sx[a : a + 256], d, ky[b : b + 1024])
            if twice:
                _add(sy[b : b + 1024], d.T, kx[a : a + 256])
    return [(uy, sx), (ux, sy)]


def _add(total: np.ndarray, d: np.ndarray, codes: np.ndarray) -> None:
    """Adds the sums of d over runs of equal codes (ascending, one for each column) to total's columns."""
    edges = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
    if len(edges) > 64:
        total[:, codes[edges[:-1]]] += np.add.reduceat(d, edges[:-1], axis=1)
        return
    for s, e in zip(edges, edges[1:], strict=False):
        total[:, codes[s]] += d[:, s:e].sum(1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.array([np.sqrt(((y - v) ** 2).sum(1)) for v in x])


def pca(index: DataFrame, k: int = 2, split: str = "train") -> tuple[DataFrame, list[float]]:
    """index with pca_1.., fitted on one split and centred by its mean; each axis points to its largest loading."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    data = index.withColumn("_x", array_to_vector(F.col("embedding").cast("array<double>")))
    train = data.filter(F.col("split") == split)
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(train)
    axes = model.pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    shift = train.select(Summarizer.mean(F.col("_x"))).first()[0].toArray() @ axes

    def coordinate(j: int):
        loading = F.array(*[F.lit(float(v)) for v in axes[:, j]])
        return F.aggregate(F.zip_with("embedding", loading, lambda a, b: a.cast("double") * b), F.lit(-float(shift[j])), lambda a, x: a + x)

    return data.drop("_x").withColumns({f"pca_{j + 1}": coordinate(j) for j in range(k)}), [float(v) for v in model.explainedVariance.toArray()]
