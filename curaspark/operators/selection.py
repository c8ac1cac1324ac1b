"""Archive entries, deterministic selection by hash rank, pairing, summaries, stale members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curaspark.functions.scalar import stem

from .contracts import ContractError, refuse, unique


def parse_archive(entries: DataFrame, classes: DataFrame, prefix: str, excluded_tokens=("_ARS",), excluded_members=()) -> DataFrame:
    """Typed rows of the image entries (member_path, file_size, compress_size) below prefix, of the classes given
    (class_id, class_label). The class comes from the folder."""
    quoted = "\\Q" + prefix.strip("/") + "\\E"
    pattern = f"(?i)^{quoted}/(PPL|XPL)-1223/(train|val|test)/(class\\d+)/([^/]+\\.(?:jpg|jpeg|png|tif|tiff))$"
    part = [F.regexp_extract("member_path", pattern, k) for k in range(5)]
    rows = entries.filter(F.col("member_path").rlike(pattern)).withColumns({"mode": F.upper(part[1]), "split": F.lower(part[2]), "folder": F.lower(part[3]), "filename": part[4]})
    for token in excluded_tokens:
        rows = rows.filter(~F.contains(F.lower("filename"), F.lit(token.lower())))
    if excluded_members:
        rows = rows.filter(~F.lower("member_path").isin([m.lower() for m in excluded_members]))
    known = classes.select("class_id", "class_label").withColumn("folder", F.lower("class_id"))
    return rows.join(known, "folder").select("member_path", "mode", "split", "class_id", "class_label", "filename", stem("filename").alias("sample_id"), "file_size", "compress_size").orderBy("split", "class_id", F.lower("sample_id"), "mode")


def missing_exclusions(entries: DataFrame, excluded: DataFrame) -> DataFrame:
    """Configured exclusions (member_path, case-sensitive) that the archive doesn't hold."""
    return excluded.select("member_path").distinct().join(entries, "member_path", "left_anti")


def hash_rank(seed: int, *columns: str) -> Column:
    """SHA-256 in hex of seed|column|column..."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *columns), 256)


def _payload(seed: int, klass: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.upper("mode"), F.col(klass), F.col("split"), F.col("sample_id")), 256)


def top_per_stratum(rows: DataFrame, n: int | Column, seed: int, klass: str = "class_name") -> DataFrame:
    """The n rows of the smallest hash in each (mode, class, split)."""
    w = W.partitionBy("mode", klass, "split").orderBy("rank_key", "sample_id")
    return rows.withColumn("rank_key", _payload(seed, klass)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def select_reserved(rows: DataFrame, requested: dict[str, int], seed: int, klass: str = "class_name") -> DataFrame:
    """Selection split by split, in the order train, val, test, others: an id chosen before in its mode and class is not
    chosen again; a split that comes up short in a stratum reserves nothing there."""
    rows = rows.withColumn("key", F.lower("sample_id")).withColumn("rank_key", _payload(seed, klass))
    same = W.partitionBy("mode", klass, "split", "key").orderBy("rank_key", "sample_id")
    rows = rows.withColumn("r", F.row_number().over(same)).filter("r = 1").drop("r")
    chosen = None
    for split in [s for s in ("train", "val", "test") if s in requested] + [s for s in requested if s not in ("train", "val", "test")]:
        left = rows.filter(F.col("split") == split)
        if chosen is not None:
            left = left.join(chosen.select("mode", klass, "key"), ["mode", klass, "key"], "left_anti")
        stratum = W.partitionBy("mode", klass)
        best = left.withColumn("place", F.row_number().over(stratum.orderBy("rank_key", "sample_id"))).filter(F.col("place") <= requested[split])
        full = best.withColumn("got", F.max("place").over(stratum)).filter(F.col("got") == requested[split]).drop("got")
        chosen = full if chosen is None else chosen.unionByName(full)
    return chosen.drop("key", "rank_key")


def shortages(selected: DataFrame, strata: DataFrame, requested: dict[str, int], klass: str = "class_name") -> DataFrame:
    """Strata (mode, class) and splits with fewer rows than requested."""
    wanted = F.explode(F.create_map(*[x for s, n in requested.items() for x in (F.lit(s), F.lit(n))])).alias("split", "wanted")
    grid = strata.select("mode", klass).distinct().select("mode", klass, wanted)
    have = selected.groupBy("mode", klass, "split").agg(F.count("*").alias("have"))
    return grid.join(have, ["mode", klass, "split"], "left").select("mode", klass, "split", "wanted", F.coalesce("have", F.lit(0)).alias("have")).filter("have < wanted")


def select_images(rows: DataFrame, strata: DataFrame, requested: dict[str, int], seed: int, klass: str = "class_id") -> DataFrame:
    """select_reserved, failing with the list of all short strata."""
    out = select_reserved(rows, requested, seed, klass)
    refuse(shortages(out, strata, requested, klass), "not enough images")
    return out.orderBy("mode", "split", klass, F.lower("sample_id"))


def exact_pairs(rows: DataFrame, klass: str = "class_id") -> DataFrame:
    """PPL and XPL rows of one split, class and id (whatever its case)."""
    keyed = rows.withColumn("key", F.lower("sample_id"))
    unique(keyed, ["mode", "split", klass, "key"], "duplicate entries")
    a, b = (keyed.filter(F.col("mode") == m).select("split", klass, "key", F.struct(*rows.columns).alias(m.lower())) for m in ("PPL", "XPL"))
    return a.join(b, ["split", klass, "key"]).select("split", klass, F.col("ppl.sample_id").alias("sample_id"), "ppl", "xpl").orderBy("split", klass, F.lower("sample_id"))


def select_pairs(pairs: DataFrame, requested: dict[str, int], seed: int, klass: str = "class_id") -> DataFrame:
    """The pairs of the smallest hash in each (class, split)."""
    w = W.partitionBy("split", klass).orderBy("rank_key", "sample_id")
    n = F.create_map(*[x for s, k in requested.items() for x in (F.lit(s), F.lit(k))])[F.col("split")]
    out = pairs.withColumn("rank_key", hash_rank(seed, klass, "split", "sample_id")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    have = out.groupBy(klass, "split").count()
    short = pairs.select(klass).distinct().crossJoin(pairs.sparkSession.createDataFrame(list(requested.items()), "split string, wanted int")).join(have, [klass, "split"], "left").filter(F.coalesce("count", F.lit(0)) < F.col("wanted"))
    refuse(short, "not enough pairs")
    return out.drop("rank_key", "place").orderBy("split", klass, F.lower("sample_id"))


def pair_summary(selected: DataFrame, klass: str = "class_id", size: str = "file_size") -> DataFrame:
    """Pairs, images (two a pair) and bytes of both images of each class and split, and the total with nulls for its keys."""
    keys, bytes_ = [F.col(klass), F.col("split")], F.sum(F.col(f"ppl.{size}") + F.col(f"xpl.{size}"))
    out = selected.groupingSets([keys, []], *keys).agg(F.count("*").alias("pairs"), (2 * F.count("*")).alias("images"), F.coalesce(bytes_, F.lit(0)).cast("long").alias("bytes"))
    return out.orderBy(F.col(klass).asc_nulls_last(), F.col("split").asc_nulls_last())


def selection_summary(selected: DataFrame, klass: str = "class_name", size: str | None = None) -> DataFrame:
    """Rows of each stratum, and the total with nulls for its keys, in one pass of grouping sets."""
    bytes_ = F.sum(size) if size else F.lit(0).cast("long")
    keys = [F.col("mode"), F.col(klass), F.col("split")]
    return selected.groupingSets([keys, []], *keys).agg(F.count("*").alias("images"), F.coalesce(bytes_, F.lit(0)).alias("bytes") if size else F.lit(0).cast("long").alias("bytes"))


def stale_members(previous: DataFrame, selected: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """Members of the previous manifest that the selection no longer has; each must be in the archive's index."""
    stale = previous.select("member_path").filter("member_path <> ''").distinct().join(selected, "member_path", "left_anti")
    if available is None:
        return stale.orderBy("member_path")
    lost = stale.join(available, "member_path", "left_anti")
    if not lost.isEmpty():
        raise ContractError(f"previous members not in the archive: {[r[0] for r in lost.limit(20).collect()]}")
    return available.join(stale, "member_path", "left_semi").orderBy("member_path")
