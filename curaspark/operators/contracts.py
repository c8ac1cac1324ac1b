"""Validation contracts: each has a DataFrame of violations (lazy) and a check that raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions.scalar import is_sha256


class ContractError(ValueError):
    """A contract is violated."""


def require_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")


def refuse(violations: DataFrame, what: str, show: int = 20) -> None:
    """Raise with the first rows if there are any."""
    rows = violations.limit(show).collect()
    if rows:
        raise ContractError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row, nulls equal to each other."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def unique(df: DataFrame, keys: list[str], what: str = "duplicate keys") -> DataFrame:
    require_columns(df, keys)
    refuse(duplicates(df, keys), what)
    return df


def join_reviews(df: DataFrame, reviews: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with columns of the reviews that have the same keys, nulls equal to each other; df's rows without one have nulls."""
    other = reviews.select(*[F.col(k).alias(f"_{k}") for k in keys], *columns)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(other, same, "left").drop(*[f"_{k}" for k in keys])


def split_conflicts(df: DataFrame, identity=("sample_id", "mode", "class_name")) -> DataFrame:
    """Identities (as they are written) that stand in more than one split; null splits don't count."""
    require_columns(df, [*identity, "split"])
    return df.groupBy(*identity).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


def conflicting_rows(df: DataFrame, identity=("sample_id", "mode", "class_name")) -> DataFrame:
    """Rows of the identities in split_conflicts."""
    bad = split_conflicts(df, identity).select(*[F.col(c).alias(f"_{c}") for c in identity])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identity])
    return df.join(bad, same, "left_semi").orderBy(*identity, "split")


def disjoint_splits(df: DataFrame) -> DataFrame:
    refuse(split_conflicts(df), "samples in several splits")
    return df


def folded_split_conflicts(df: DataFrame) -> DataFrame:
    """The same with mode upper-cased, ids lower-cased and all trimmed."""
    require_columns(df, ["mode", "class_id", "sample_id", "split"])
    k = df.select(F.upper(F.trim("mode")).alias("mode"), F.lower(F.trim("class_id")).alias("class_id"), F.lower(F.trim("sample_id")).alias("sample_id"), F.lower(F.trim("split")).alias("split"))
    return k.groupBy("mode", "class_id", "sample_id").agg(F.sort_array(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)


def blank_identities(df: DataFrame) -> DataFrame:
    blank = [F.coalesce(F.trim(c), F.lit("")) == "" for c in ("mode", "class_id", "sample_id", "split")]
    return df.filter(reduce(lambda a, b: a | b, blank))


def manifest_splits(df: DataFrame) -> DataFrame:
    require_columns(df, ["mode", "class_id", "sample_id", "split"])
    refuse(blank_identities(df), "blank identity")
    refuse(folded_split_conflicts(df), "samples in several splits")
    return df


def repeated_hashes(df: DataFrame, member: str = "archive_member") -> DataFrame:
    """Content hashes of more than one row, with how many and the first and last member."""
    return df.groupBy("sha256").agg(F.count("*").alias("rows"), F.min(member).alias("first_member"), F.max(member).alias("last_member")).filter("rows > 1")


def unique_hashes(df: DataFrame) -> DataFrame:
    require_columns(df, ["sha256", "archive_member"])
    refuse(df.filter(~is_sha256("sha256")), "not a sha256")
    refuse(repeated_hashes(df), "repeated content")
    return df


def review_file(reviews: DataFrame, keys: list[str], decision: str, allowed) -> DataFrame:
    require_columns(reviews, [*keys, decision])
    unique(reviews, keys, "duplicate reviews")
    refuse(reviews.filter(F.col(decision).isNotNull() & ~F.col(decision).isin(*allowed)).select(decision).distinct(), "unknown decisions")
    return reviews


def alignment_violations(df: DataFrame) -> DataFrame:
    """One row that says what is wrong with embedding_row (0 to n-1), lengths and components; none if all is well."""
    e = F.col("embedding")
    bad: Column = e.isNull() | (F.size(e) == 0) | ~F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    about = df.agg(F.count("*").alias("n"), F.min("embedding_row").alias("lo"), F.max("embedding_row").alias("hi"), F.countDistinct("embedding_row").alias("rows"), F.count_if(bad).alias("bad"), F.min(F.size(e)).alias("short"), F.max(F.size(e)).alias("long"))
    return about.filter("n > 0 AND (lo <> 0 OR hi <> n - 1 OR rows <> n OR bad > 0 OR short <> long)")


def aligned(df: DataFrame) -> DataFrame:
    require_columns(df, ["embedding_row", "embedding"])
    refuse(alignment_violations(df), "embeddings and index don't fit")
    return df


def c_grid(values) -> list[float]:
    """Distinct regularisation strengths, ascending; all must be above 0."""
    out = sorted({float(v) for v in values})
    if not out or out[0] <= 0:
        raise ContractError("C values must be given and above 0")
    return out


def complete_classes(df: DataFrame, splits=("train", "val", "test"), modes: int = 2) -> DataFrame:
    """Every class of the table in each split of each mode, and so many modes."""
    grid = df.select("mode").distinct().join(df.select("class_name").distinct(), how="cross").join(df.sparkSession.createDataFrame([(s,) for s in splits], "split string"), how="cross")
    refuse(grid.join(df, ["mode", "class_name", "split"], "left_anti"), "classes missing in")
    if df.select("mode").distinct().count() != modes:
        raise ContractError(f"exactly {modes} modes are needed")
    return df


def ready_for_embedding(near_duplicate_report: DataFrame, quality_report: DataFrame, images: int) -> None:
    """The gates before images are embedded: no near duplicate waits for a decision, and so many images are accepted."""
    refuse(near_duplicate_report.filter("decision = 'pending_review'"), "near duplicates without a decision")
    accepted = quality_report.filter(F.col("use_for_model")).count()
    if accepted != images:
        raise ContractError(f"{accepted} accepted images, {images} expected")


def fold_feasibility(df: DataFrame, outer: int, inner: int) -> DataFrame:
    """least, most: class sizes of each mode; feasible: whether outer and inner folds can hold each class."""
    if outer < 2 or inner < 2:
        raise ContractError("at least two outer and two inner folds")
    sizes = df.groupBy("mode", "class_name").agg(F.count("*").alias("n")).groupBy("mode").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    ok = (F.col("least") >= outer) & (F.col("least") - F.ceil(F.col("most") / outer) >= inner)
    return sizes.withColumn("feasible", ok)
