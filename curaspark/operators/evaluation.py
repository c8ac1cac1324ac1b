"""Scores of predictions and clusterings, folds, and summaries of repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curaspark.functions.scalar import evaluation_label


def confusion_matrix(predictions: DataFrame, groups: list[str]) -> DataFrame:
    """Counts over the full grid of labels, zeros too."""
    labels = predictions.select(F.explode(F.array("true_class", "predicted_class")).alias("c")).distinct()
    grid = predictions.select(*groups).distinct().join(labels.withColumnRenamed("c", "true_class"), how="cross").join(labels.withColumnRenamed("c", "predicted_class"), how="cross")
    n = predictions.groupBy(*groups, "true_class", "predicted_class").agg(F.count("*").alias("n"))
    return grid.join(n, [*groups, "true_class", "predicted_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def probe_metrics(predictions: DataFrame, groups: list[str]) -> DataFrame:
    """accuracy, balanced_accuracy (mean recall of the true labels) and macro_f1 (over all labels, 0 where undefined)."""
    n = predictions.groupBy(*groups, "true_class", "predicted_class").agg(F.count("*").alias("n"))
    hit = F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0)
    sides = n.select(*groups, F.explode(F.array(F.struct(F.col("true_class").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), hit.alias("tp")), F.struct(F.col("predicted_class").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))).alias("s"))
    per = sides.groupBy(*groups, "s.c").agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum("s.tp").alias("tp"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("t") + F.col("p")), F.lit(0.0))
    recall = F.when(F.col("t") > 0, F.col("tp") / F.col("t"))
    return per.groupBy(*groups).agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"), F.sum("t").alias("samples"))


def select_best(scores: DataFrame, groups: list[str], score: str = "score", c: str = "c") -> DataFrame:
    """Best mean score of each group, the smallest c among ties."""
    mean = scores.groupBy(*groups, c).agg(F.avg(score).alias("mean_score"))
    best = F.max(F.struct("mean_score", (-F.col(c)).alias("less"))).alias("b")
    return mean.groupBy(*groups).agg(best).select(*groups, (-F.col("b.less")).alias("selected_c"), F.col("b.mean_score").alias("mean_score"))


def fold_assignment(rows: DataFrame, folds: int, repeats: int, seed: int, by: str = "mode") -> DataFrame:
    """fold of every row in every repeat: rows are dealt out in turn, class by class in the order of a hash."""
    many = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    many = many.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), F.col("sample_id")), 256))
    keys = [by, "repeat", "class_name"]
    sizes = many.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(by, "repeat").orderBy("class_name").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = many.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_h", "sample_id"))).join(before, keys)
    return out.withColumn("fold", ((F.col("_before") + F.col("_r") - 1) % folds).cast("int")).drop("_h", "_r", "_before")


def run_numbers(run: Column, outer: int) -> tuple[Column, Column]:
    """Repeat and fold (from 1) of a run number."""
    return (F.floor(run / outer) + 1).cast("int"), (run % outer + 1).cast("int")


def scenarios(df: DataFrame) -> DataFrame:
    """The distinct pairs of training domain and evaluation mode in order, with their label."""
    pairs = df.select("training_domain", "evaluation_mode").distinct().orderBy("training_domain", "evaluation_mode")
    return pairs.withColumn("scenario", evaluation_label("training_domain", "evaluation_mode"))


def stability_summary(folds: DataFrame, metrics=("macro_f1", "accuracy", "balanced_accuracy"), groups=("training_domain", "evaluation_mode", "relation")) -> DataFrame:
    aggs = [F.count("*").alias("runs"), F.median("selected_c").alias("median_selected_c")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return folds.groupBy(*groups).agg(*aggs)


def five_numbers(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    p = F.percentile(column, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return df.groupBy(*groups).agg(p.alias("p")).select(*groups, *[F.col("p")[k].alias(n) for k, n in enumerate(("low", "q1", "median", "q3", "high"))])


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def clustering_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labelings, from their contingency table."""
    cell = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows, cols = (cell.groupBy(k).agg(F.sum("n").alias("m")) for k in ("a", "b"))
    total = cell.agg(F.sum("n").alias("t"), F.sum(_pairs(F.col("n"))).alias("both"))

    def entropy(t: DataFrame, k: str) -> DataFrame:
        return t.crossJoin(total.select("t")).agg(F.sum(_pairs(F.col("m"))).alias(f"pairs_{k}"), (-F.sum(F.col("m") / F.col("t") * F.log(F.col("m") / F.col("t")))).alias(f"h_{k}"))

    mi = cell.join(rows.withColumnRenamed("m", "ma"), "a").join(cols.withColumnRenamed("m", "mb"), "b").crossJoin(total.select("t"))
    mi = mi.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n").cast("double") * F.col("t") / (F.col("ma").cast("double") * F.col("mb")))).alias("mi"))
    one = total.crossJoin(entropy(rows, "a")).crossJoin(entropy(cols, "b")).crossJoin(mi)  # single rows
    expected = F.try_divide(F.col("pairs_a") * F.col("pairs_b"), _pairs(F.col("t")))
    spread = (F.col("pairs_a") + F.col("pairs_b")) / 2 - expected
    mean_h = (F.col("h_a") + F.col("h_b")) / 2
    return one.select(F.when(spread == 0, F.lit(1.0)).otherwise((F.col("both") - expected) / spread).alias("ari"), F.when(mean_h == 0, F.lit(1.0)).otherwise(F.col("mi") / mean_h).alias("nmi"))
