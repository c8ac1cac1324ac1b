"""Image quality: pixel metrics, threshold rules, manual reviews, summary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import join_reviews, review_file, unique

REVIEW_KEY = ["mode", "split", "class_name", "sample_id"]
DECISIONS = ("keep", "exclude")
#: Flags in the order in which they are joined.
FLAGS = ("baixa_luminosidade", "alta_luminosidade", "baixo_contraste", "possivel_desfoque")
READ_ERROR_FLAG = "erro_leitura"


def pixel_metrics(gray: np.ndarray) -> tuple[float, float, float]:
    """Mean, population deviation, and variance of the 4-neighbour Laplacian with mirrored borders."""
    g = gray.astype(np.float64)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplace = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    return float(g.mean()), float(g.std()), float(laplace.var())


def image_metrics(images: DataFrame) -> DataFrame:
    """path, width, height, brightness, contrast, sharpness of images that could be decoded."""
    from curaspark.sources.images import to_gray

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.path, r.width, r.height, *pixel_metrics(to_gray(r.data, r.height, r.width, r.nChannels))) for r in b.itertuples()]
            yield pd.DataFrame(rows, columns=["path", "width", "height", "brightness", "contrast", "sharpness"])

    return images.filter("height > 0").select("path", "height", "width", "nChannels", "data").mapInPandas(run, "path string, width int, height int, brightness double, contrast double, sharpness double")


def flags(thresholds: dict[str, float]) -> Column:
    """Names of the rules that a row breaks, joined by ';'. Nulls and NaN break none."""

    def value(c: str) -> Column:
        return F.when(~F.isnan(c), F.col(c))

    low, high = F.lit(float(thresholds["min_brightness"])), F.lit(float(thresholds["max_brightness"]))
    tests = (value("brightness") < low, value("brightness") > high, value("contrast") < float(thresholds["min_contrast"]), value("sharpness") < float(thresholds["min_sharpness"]))
    return F.concat_ws(";", *[F.when(t, F.lit(f)) for t, f in zip(tests, FLAGS, strict=True)])


def apply_quality_rules(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    out = metrics.withColumn("quality_flags", flags(thresholds))
    ok = F.col("quality_flags") == ""
    return out.withColumns({"automatic_quality_ok": ok, "review_required": ~ok, "automatic_status": F.when(ok, "pass").otherwise("review")})


def evaluate_catalog(catalog: DataFrame, images: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Catalog with metrics and verdicts; a file that cannot be read has a read_error row instead of failing the job."""
    judged = catalog.join(image_metrics(images), "path", "left").withColumn("read_error", F.when(F.col("width").isNull(), "image cannot be decoded").otherwise(""))
    out = apply_quality_rules(judged, thresholds)
    failed = F.col("read_error") != ""
    return out.withColumns(
        {
            "quality_flags": F.when(failed, READ_ERROR_FLAG).otherwise(F.col("quality_flags")),
            "automatic_quality_ok": ~failed & F.col("automatic_quality_ok"),
            "review_required": failed | F.col("review_required"),
            "automatic_status": F.when(failed, "read_error").otherwise(F.col("automatic_status")),
        }
    )


def final_status(report: DataFrame) -> DataFrame:
    """final_status and use_for_model from automatic_quality_ok, manual_decision and read_error."""
    d = F.coalesce(F.lower(F.trim("manual_decision")), F.lit(""))
    error = F.coalesce(F.col("read_error"), F.lit("")) != ""
    auto = F.coalesce(F.col("automatic_quality_ok"), F.lit(False))
    status = F.when(error, "read_error").when(d == "exclude", "manual_exclude").when(d == "keep", "manual_keep").when(auto, "automatic_pass").otherwise("pending_review")
    return report.withColumns({"final_status": status, "use_for_model": (auto | (d == "keep")) & ~((d == "exclude") | error)})


def apply_manual_reviews(report: DataFrame, reviews: DataFrame) -> DataFrame:
    """Report left-joined with its reviews; reviews that fit no row are dropped."""
    review_file(reviews, REVIEW_KEY, "manual_decision", DECISIONS)
    unique(report, REVIEW_KEY)
    joined = join_reviews(report, reviews, REVIEW_KEY, ["manual_decision", "review_notes"])
    return final_status(joined.withColumns({"manual_decision": F.coalesce("manual_decision", F.lit("")), "review_notes": F.coalesce("review_notes", F.lit(""))}))


def summarise_quality(report: DataFrame, keys=("mode", "split")) -> DataFrame:
    def mean(c: str) -> Column:
        return F.avg(F.when(~F.isnan(c), F.col(c)))

    accepted = F.count_if("use_for_model")
    return report.groupBy(*keys).agg(
        F.count("path").alias("images"),
        F.count_if("automatic_quality_ok").alias("automatic_pass"),
        F.count_if(F.col("final_status") == "manual_keep").alias("manual_keep"),
        F.count_if(F.col("final_status") == "pending_review").alias("pending_review"),
        accepted.alias("accepted_for_model"),
        mean("brightness").alias("mean_brightness"),
        mean("contrast").alias("mean_contrast"),
        mean("sharpness").alias("mean_sharpness"),
        F.try_divide(accepted, F.count("path")).alias("acceptance_rate"),
    )
