"""The registered queries over the driver's tables, with their DuckDB counterparts.

The tables stand in for an image archive: ``idx`` gives every embedding a mode, split, class and sample id, its 64 floats
serve as the 8 x 8 frequencies of a perceptual hash, documents as images with measured qualities, labels as reviews.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.functions import scalar
from curaspark.operators import catalog, contracts, evaluation, integrity, models, quality, selection, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

IDX = """idx AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS sample_id, CASE WHEN vec_id % 2 = 0 THEN 'PPL' ELSE 'XPL' END AS mode,
CASE WHEN (vec_id // 2) % 10 < 7 THEN 'train' WHEN (vec_id // 2) % 10 < 9 THEN 'val' ELSE 'test' END AS split,
'class' || CAST(label % 4 AS VARCHAR) AS class_name, 'img/' || CAST(vec_id AS VARCHAR) || '.png' AS path, label, embedding FROM embeddings)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    turn = F.floor(F.col("vec_id") / 2) % 10
    return e.select(
        "vec_id",
        F.col("vec_id").cast("string").alias("sample_id"),
        F.when(F.col("vec_id") % 2 == 0, "PPL").otherwise("XPL").alias("mode"),
        F.when(turn < 7, "train").when(turn < 9, "val").otherwise("test").alias("split"),
        F.concat(F.lit("class"), (F.col("label") % 4).cast("string")).alias("class_name"),
        F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"),
        "label",
        "embedding",
    )


def _stratified(seed: int) -> str:
    return f"""SELECT mode, class_name, split, sample_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY mode, class_name, split
ORDER BY sha256(concat_ws('|', '{seed}', mode, class_name, split, sample_id)), sample_id) AS place FROM idx) WHERE place <= 3"""


@query(f"WITH {IDX} {_stratified(42)}")
def select_stratified(spark, sf_dir):
    return selection.top_per_stratum(idx(spark, sf_dir), 3, 42).select("mode", "class_name", "split", "sample_id", "place")


REUSED = "reused AS (SELECT DISTINCT mode, class_name, split, CAST(vec_id % 37 AS VARCHAR) AS sample_id FROM idx)"
WANTED = {"train": 3, "val": 2, "test": 1}


def _reserve() -> str:
    parts, names = [], []
    for split, n in WANTED.items():
        anti = "".join(f" AND NOT EXISTS (SELECT 1 FROM got_{p} g WHERE g.mode = r.mode AND g.class_name = r.class_name AND g.sample_id = r.sample_id)" for p in names)
        parts.append(f"rank_{split} AS (SELECT r.*, row_number() OVER (PARTITION BY mode, class_name ORDER BY sha256(concat_ws('|', '42', mode, class_name, split, sample_id)), sample_id) AS place FROM reused r WHERE split = '{split}'{anti})")
        parts.append(f"got_{split} AS (SELECT * FROM rank_{split} a WHERE place <= {n} AND (SELECT max(place) FROM rank_{split} b WHERE b.mode = a.mode AND b.class_name = a.class_name) >= {n})")
        names.append(split)
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT mode, class_name, split, sample_id, CAST(place AS INT) AS place FROM got_{s}" for s in names)


def reused_ids(spark, sf_dir):
    return idx(spark, sf_dir).select("mode", "class_name", "split", (F.col("vec_id") % 37).cast("string").alias("sample_id")).distinct()


@query(f"WITH {IDX}, {REUSED}, {_reserve()}")
def select_reserved(spark, sf_dir):
    return selection.select_reserved(reused_ids(spark, sf_dir), WANTED, 42).select("mode", "class_name", "split", "sample_id", "place")


@query(f"""WITH {IDX}, {REUSED}, sel AS (SELECT mode, class_name, split, count(*) AS have FROM ({_stratified(42).replace('idx', 'reused')}) GROUP BY ALL),
grid AS (SELECT DISTINCT mode, class_name, s AS split, w AS wanted FROM idx, (VALUES ('train', 4), ('val', 3), ('test', 2)) v(s, w))
SELECT g.mode, g.class_name, g.split, g.wanted, coalesce(have, 0) AS have FROM grid g LEFT JOIN sel USING (mode, class_name, split) WHERE coalesce(have, 0) < wanted""")
def selection_shortages(spark, sf_dir):
    got = selection.top_per_stratum(reused_ids(spark, sf_dir), 3, 42)
    return selection.shortages(got, idx(spark, sf_dir), {"train": 4, "val": 3, "test": 2})


@query(f"""WITH {IDX}, sel AS ({_stratified(42)}) SELECT mode, class_name, split, count(*) AS images, CAST(sum(CAST(sample_id AS BIGINT) % 1000) AS BIGINT) AS bytes FROM sel GROUP BY GROUPING SETS ((mode, class_name, split), ())""")
def selection_summary(spark, sf_dir):
    rows = select_stratified(spark, sf_dir).withColumn("file_size", F.col("sample_id").cast("long") % 1000)
    return selection.selection_summary(rows, size="file_size")


ENTRIES = """entries AS (SELECT doc_id, 'Data/Carbonate/' || CASE WHEN doc_id % 2 = 0 THEN 'ppl' ELSE 'XPL' END || '-1223/' || CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'Val' ELSE 'test' END || '/class' || CAST(doc_id % 5 AS VARCHAR) AS folder,
'Sample.' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 11 = 0 THEN '_ars' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN '.txt' ELSE '.JPG' END AS name, n_chars FROM documents)"""
LABELS = [("class0", "Cemented fracture"), ("class1", "Micritic limestone (a)"), ("class2", "  Grain--stone "), ("class3", "Vuggy")]


@query(f"""WITH {ENTRIES}, labels_(class_id, class_label) AS (VALUES {', '.join(map(str, LABELS))})
SELECT folder || '/' || name AS member_path, CASE WHEN doc_id % 2 = 0 THEN 'PPL' ELSE 'XPL' END AS mode, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, class_id, class_label, name AS filename,
replace(name, '.JPG', '') AS sample_id, n_chars AS file_size, n_chars // 2 AS compress_size, class_id || '_' || trim(regexp_replace(lower(class_label), '[^a-z0-9]+', '_', 'g'), '_') AS slug
FROM entries JOIN labels_ ON class_id = 'class' || CAST(doc_id % 5 AS VARCHAR) WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id <> 7""")
def parse_archive(spark, sf_dir):
    d = F.col("doc_id")
    mode, split = F.when(d % 2 == 0, "ppl").otherwise("XPL"), F.when(d % 3 == 0, "train").when(d % 3 == 1, "Val").otherwise("test")
    name = F.concat(F.lit("Sample."), d.cast("string"), F.when(d % 11 == 0, "_ars").otherwise(""), F.when(d % 13 == 0, ".txt").otherwise(".JPG"))
    path = F.concat(F.lit("Data/Carbonate/"), mode, F.lit("-1223/"), split, F.lit("/class"), (d % 5).cast("string"), F.lit("/"), name)
    entries = table(spark, sf_dir, "documents").select(path.alias("member_path"), F.col("n_chars").alias("file_size"), F.floor(F.col("n_chars") / 2).alias("compress_size"))
    classes = spark.createDataFrame(LABELS, "class_id string, class_label string")
    rows = selection.parse_archive(entries, classes, "Data/Carbonate", excluded_members=["data/carbonate/xpl-1223/VAL/class2/sample.7.jpg"])
    return rows.withColumn("slug", scalar.slug("class_id", "class_label"))


PAIRED = "paired AS (SELECT CAST(vec_id // 3 AS VARCHAR) AS sample_id, mode, split, min(path) AS path FROM idx GROUP BY ALL)"


def paired(spark, sf_dir):
    rows = idx(spark, sf_dir).withColumn("sample_id", F.floor(F.col("vec_id") / 3).cast("string"))
    return rows.groupBy("sample_id", "mode", "split").agg(F.min("path").alias("path")).withColumn("class_name", F.lit("all"))


@query(f"""WITH {IDX}, {PAIRED}, w AS (SELECT sample_id, split, max(CASE WHEN mode = 'PPL' THEN path END) AS "path_PPL", max(CASE WHEN mode = 'XPL' THEN path END) AS "path_XPL" FROM paired GROUP BY ALL)
SELECT *, "path_PPL" IS NOT NULL AND "path_XPL" IS NOT NULL AS has_pair FROM w""")
def catalog_pairs(spark, sf_dir):
    return catalog.pair_table(paired(spark, sf_dir)).drop("class_name")


@query(f"WITH {IDX}, {PAIRED} SELECT a.split, a.sample_id, a.path AS ppl_path, b.path AS xpl_path FROM paired a JOIN paired b ON a.mode = 'PPL' AND b.mode = 'XPL' AND a.split = b.split AND lower(a.sample_id) = lower(b.sample_id)")
def exact_pairs(spark, sf_dir):
    return selection.exact_pairs(paired(spark, sf_dir), "class_name").select("split", "sample_id", F.col("ppl.path").alias("ppl_path"), F.col("xpl.path").alias("xpl_path"))


PICKED = f"""{PAIRED}, pairs AS (SELECT a.split, a.sample_id, a.path AS ppl_path, b.path AS xpl_path, a.size AS size FROM (SELECT *, length(path) AS size FROM paired) a JOIN paired b ON a.mode = 'PPL' AND b.mode = 'XPL' AND a.split = b.split AND a.sample_id = b.sample_id),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256(concat_ws('|', '42', 'all', split, sample_id)), sample_id) AS r FROM pairs) WHERE r <= CASE split WHEN 'train' THEN 9 WHEN 'val' THEN 3 ELSE 2 END)"""


def picked_pairs(spark, sf_dir):
    rows = paired(spark, sf_dir).withColumn("file_size", F.length("path").cast("long"))
    return selection.select_pairs(selection.exact_pairs(rows, "class_name"), {"train": 9, "val": 3, "test": 2}, 42, "class_name")


@query(f"WITH {IDX}, {PICKED} SELECT split, sample_id, ppl_path, xpl_path FROM picked")
def select_pairs(spark, sf_dir):
    return picked_pairs(spark, sf_dir).select("split", "sample_id", F.col("ppl.path").alias("ppl_path"), F.col("xpl.path").alias("xpl_path"))


@query(f"""WITH {IDX}, {PICKED} SELECT CASE WHEN split IS NULL THEN NULL ELSE 'all' END AS class_name, split, count(*) AS pairs, 2 * count(*) AS images, CAST(sum(length(ppl_path) + length(xpl_path)) AS BIGINT) AS bytes FROM picked GROUP BY GROUPING SETS ((split), ())""")
def pair_summary(spark, sf_dir):
    return selection.pair_summary(picked_pairs(spark, sf_dir), "class_name")


@query(f"WITH {IDX}, old AS ({_stratified(41)}), new AS ({_stratified(42)}) SELECT sample_id AS member_path FROM old EXCEPT SELECT sample_id FROM new")
def stale_members(spark, sf_dir):
    rows = idx(spark, sf_dir)
    old, new = (selection.top_per_stratum(rows, 3, s).select(F.col("sample_id").alias("member_path")) for s in (41, 42))
    return selection.stale_members(old, new)


@query(f"WITH {IDX}, {REUSED}, bad AS (SELECT sample_id, mode, class_name FROM reused GROUP BY ALL HAVING count(DISTINCT split) > 1) SELECT r.* FROM reused r SEMI JOIN bad USING (sample_id, mode, class_name)")
def split_conflicts(spark, sf_dir):
    return contracts.conflicting_rows(reused_ids(spark, sf_dir)).select("mode", "class_name", "split", "sample_id")


@query(f"WITH {IDX}, {REUSED} SELECT mode, lower(class_name) AS class_id, lower(trim(sample_id)) AS sample_id, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM reused GROUP BY ALL HAVING count(DISTINCT split) > 1")
def folded_split_conflicts(spark, sf_dir):
    rows = reused_ids(spark, sf_dir).withColumnRenamed("class_name", "class_id").withColumn("sample_id", F.concat(F.lit(" "), "sample_id"))
    return contracts.folded_split_conflicts(rows).withColumn("splits", F.array_join("splits", ","))


@query("SELECT sha256(text) AS sha256, count(*) AS rows, min(doc_id) AS first_member, max(doc_id) AS last_member FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return contracts.repeated_hashes(docs.select("doc_id", F.sha2("text", 256).alias("sha256")), "doc_id")


MEASURED = """measured AS (SELECT doc_id, lang AS mode, source AS split, 'doc' AS class_name, CAST(doc_id AS VARCHAR) AS sample_id, CAST(doc_id AS VARCHAR) AS path, CAST(n_chars % 256 AS DOUBLE) AS brightness,
CAST(n_chars % 97 AS DOUBLE) AS contrast, CAST(n_chars % 331 AS DOUBLE) AS sharpness, '' AS read_error FROM documents)"""
LIMITS = {"min_brightness": 35, "max_brightness": 220, "min_contrast": 18, "min_sharpness": 60}
FLAGGED = """flagged AS (SELECT *, concat_ws(';', CASE WHEN brightness < 35 THEN 'baixa_luminosidade' END, CASE WHEN brightness > 220 THEN 'alta_luminosidade' END,
CASE WHEN contrast < 18 THEN 'baixo_contraste' END, CASE WHEN sharpness < 60 THEN 'possivel_desfoque' END) AS quality_flags FROM measured)"""
REVIEWED = """reviewed AS (SELECT f.*, quality_flags = '' AS auto, CASE WHEN toxic = 1 THEN 'exclude' WHEN quality = 1 THEN 'keep' ELSE '' END AS d FROM flagged f LEFT JOIN labels USING (doc_id)),
final AS (SELECT *, CASE WHEN d = 'exclude' THEN 'manual_exclude' WHEN d = 'keep' THEN 'manual_keep' WHEN auto THEN 'automatic_pass' ELSE 'pending_review' END AS final_status, (auto OR d = 'keep') AND d <> 'exclude' AS use_for_model FROM reviewed)"""


def measured(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    parts = [(F.col("n_chars") % m).cast("double").alias(c) for c, m in (("brightness", 256), ("contrast", 97), ("sharpness", 331))]
    return docs.select("doc_id", F.col("lang").alias("mode"), F.col("source").alias("split"), F.lit("doc").alias("class_name"), key.alias("sample_id"), key.alias("path"), *parts, F.lit("").alias("read_error"))


@query(f"WITH {MEASURED}, {FLAGGED} SELECT doc_id, quality_flags, quality_flags = '' AS automatic_quality_ok, quality_flags <> '' AS review_required, CASE WHEN quality_flags = '' THEN 'pass' ELSE 'review' END AS automatic_status FROM flagged")
def quality_flags(spark, sf_dir):
    return quality.apply_quality_rules(measured(spark, sf_dir), LIMITS).select("doc_id", "quality_flags", "automatic_quality_ok", "review_required", "automatic_status")


def reviewed(spark, sf_dir):
    flagged = quality.apply_quality_rules(measured(spark, sf_dir), LIMITS)
    decision = F.when(F.col("toxic") == 1, "exclude").when(F.col("quality") == 1, "keep")
    labels = table(spark, sf_dir, "labels").select("doc_id", decision.alias("manual_decision"), F.lit("seen").alias("review_notes")).filter("manual_decision is not null")
    reviews = measured(spark, sf_dir).join(labels, "doc_id").select(*quality.REVIEW_KEY, "manual_decision", "review_notes")
    return quality.apply_manual_reviews(flagged, reviews)


@query(f"WITH {MEASURED}, {FLAGGED}, {REVIEWED} SELECT doc_id, d AS manual_decision, final_status, use_for_model FROM final")
def quality_review(spark, sf_dir):
    return reviewed(spark, sf_dir).select("doc_id", F.coalesce("manual_decision", F.lit("")).alias("manual_decision"), "final_status", "use_for_model")


@query(f"""WITH {MEASURED}, {FLAGGED}, {REVIEWED} SELECT mode, split, count(path) AS images, count(*) FILTER (WHERE auto) AS automatic_pass, count(*) FILTER (WHERE final_status = 'manual_keep') AS manual_keep, count(*) FILTER (WHERE final_status = 'pending_review') AS pending_review,
count(*) FILTER (WHERE use_for_model) AS accepted_for_model, round(avg(brightness), 6) AS mean_brightness, round(avg(contrast), 6) AS mean_contrast, round(avg(sharpness), 6) AS mean_sharpness, round(count(*) FILTER (WHERE use_for_model) / count(path), 6) AS acceptance_rate FROM final GROUP BY ALL""")
def quality_summary(spark, sf_dir):
    return rounded(quality.summarise_quality(reviewed(spark, sf_dir)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats rounded, so that sums in another order compare equal; no negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


HASHED = f"""hashed AS (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(embedding[2:64], lambda x: CAST(x > list_sort(embedding[2:64])[32] AS BIGINT))), lambda a, b: a * 2 + b) AS phash FROM idx)"""


def hashed_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"phash": integrity.pack_bits(F.col("embedding")), "row_id": F.col("vec_id"), "class_id": F.col("class_name"), "archive_member": F.col("path")})


def hashed(spark, sf_dir):
    return hashed_rows(idx(spark, sf_dir))


@query(f"WITH {IDX}, {HASHED} SELECT vec_id, phash, CAST(bit_count(phash) AS INT) AS bits FROM hashed")
def phash_signature(spark, sf_dir):
    return hashed(spark, sf_dir).select("vec_id", "phash", F.bit_count("phash").alias("bits"))


def _near(d: int) -> str:
    return f"""SELECT a.mode, a.class_name AS class_id, a.split AS split_a, a.sample_id AS sample_id_a, b.split AS split_b, b.sample_id AS sample_id_b, CAST(bit_count(xor(a.phash, b.phash)) AS INT) AS distance
FROM hashed a JOIN hashed b ON a.mode = b.mode AND a.class_name = b.class_name AND a.vec_id < b.vec_id AND a.split <> b.split AND bit_count(xor(a.phash, b.phash)) <= {d}"""


KEYS = ["mode", "class_id", "split_a", "sample_id_a", "split_b", "sample_id_b"]


@query(f"WITH {IDX}, {HASHED} {_near(18)}")
def near_duplicates(spark, sf_dir):
    return integrity.near_duplicates(hashed(spark, sf_dir), 18).select(*KEYS, "distance")


#: Copies in another split with the signs of the last four components turned: near duplicates for the banded join.
COPIED = f"""copied AS (SELECT * FROM idx UNION ALL SELECT vec_id + 1000000000 AS vec_id, sample_id || 'c' AS sample_id, mode, CASE split WHEN 'train' THEN 'val' ELSE 'train' END AS split, class_name, path, label,
list_concat(embedding[1:60], list_transform(embedding[61:64], lambda x: -x)) AS embedding FROM idx WHERE vec_id % 7 = 0), {HASHED.replace("FROM idx", "FROM copied")}"""


def copied(spark, sf_dir):
    rows = idx(spark, sf_dir)
    turned = F.concat(F.slice("embedding", 1, 60), F.transform(F.slice("embedding", 61, 4), lambda x: -x))
    split = F.when(F.col("split") == "train", "val").otherwise("train")
    copies = rows.filter("vec_id % 7 = 0").withColumns({"embedding": turned, "split": split, "vec_id": F.col("vec_id") + 1000000000, "sample_id": F.concat("sample_id", F.lit("c"))})
    return rows.unionByName(copies)


@query(f"WITH {IDX}, {COPIED} {_near(7)}")
def near_duplicates_banded(spark, sf_dir):
    return integrity.near_duplicates(hashed_rows(copied(spark, sf_dir)), 7).select(*KEYS, "distance")


@query(f"WITH {IDX}, {HASHED}, pairs AS ({_near(18)}) SELECT *, CASE WHEN CAST(sample_id_a AS BIGINT) % 3 = 0 THEN 'distinct_keep' ELSE 'pending_review' END AS decision FROM pairs")
def near_dup_reviews(spark, sf_dir):
    report = near_duplicates(spark, sf_dir).persist()  # read five times
    reviews = report.filter(F.col("sample_id_a").cast("long") % 3 == 0).select(*KEYS, F.lit("distinct_keep").alias("decision"), F.lit("seen").alias("notes"))
    return integrity.apply_near_duplicate_reviews(report, reviews).select(*KEYS, "distance", "decision")


@query(f"""WITH {IDX}, {HASHED}, pairs AS ({_near(18)}) SELECT count(*) FILTER (WHERE CAST(sample_id_a AS BIGINT) % 3 <> 0) AS pending, count(*) FILTER (WHERE CAST(sample_id_a AS BIGINT) % 3 = 0) AS reviewed FROM pairs""")
def review_tally(spark, sf_dir):
    return integrity.review_tally(near_dup_reviews(spark, sf_dir))


@query(f"""WITH {IDX} SELECT row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, mode, class_name, sample_id) - 1 AS embedding_row, sample_id, mode, split, class_name, path FROM idx WHERE vec_id % 5 <> 0""")
def model_inputs(spark, sf_dir):
    report = idx(spark, sf_dir).withColumn("use_for_model", F.when(F.col("vec_id") % 5 != 0, " True").otherwise("0"))
    return vectors.select_model_inputs(report)


@query(f"""WITH {IDX}, n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: (3 * x) * (3 * x)))) AS len FROM idx)
SELECT vec_id, round(len, 6) AS len, round(3 * v[1] / len, 6) + 0 AS first, round(3 * v[64] / len, 6) + 0 AS last FROM n""")
def l2_normalize(spark, sf_dir):
    e = idx(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("embedding"))
    out = vectors.l2_normalise(e.withColumn("len", scalar.norm("embedding")))
    return rounded(out.select("vec_id", "len", F.col("embedding")[0].alias("first"), F.col("embedding")[63].alias("last")))


@query(f"WITH {IDX} SELECT count(*) AS n, min(len(embedding)) AS short, max(len(embedding)) AS long, CAST(count(DISTINCT vec_id) AS BIGINT) AS rows FROM idx")
def embedding_alignment(spark, sf_dir):
    return contracts.aligned(idx(spark, sf_dir).withColumn("embedding_row", F.col("vec_id"))).agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("short"), F.max(F.size("embedding")).cast("long").alias("long"), F.countDistinct("vec_id").alias("rows"))


PROTO = """m AS (SELECT mode, class_name, pos, avg(x) AS x FROM (SELECT mode, class_name, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM idx WHERE split = 'train') GROUP BY ALL),
proto AS (SELECT mode, class_name, pos, x / sqrt(sum(x * x) OVER (PARTITION BY mode, class_name)) AS x FROM m),
sim AS (SELECT a.mode AS source_mode, a.class_name AS source_class, b.mode AS target_mode, b.class_name AS target_class, sum(a.x * b.x) AS cosine_similarity, a.class_name = b.class_name AS same_class FROM proto a JOIN proto b USING (pos) GROUP BY ALL)"""


@query(f"WITH {IDX}, {PROTO} SELECT source_mode, source_class, target_mode, target_class, round(cosine_similarity, 6) + 0 AS cosine_similarity, same_class FROM sim")
def prototype_similarity(spark, sf_dir):
    return rounded(vectors.prototype_similarity(vectors.prototypes(idx(spark, sf_dir))))


@query(f"""WITH {IDX}, {PROTO} SELECT round(avg(cosine_similarity) FILTER (same_class), 6) + 0 AS same_class_mean, round(avg(cosine_similarity) FILTER (NOT same_class), 6) + 0 AS different_class_mean,
round(avg(cosine_similarity) FILTER (same_class) - avg(cosine_similarity) FILTER (NOT same_class), 6) + 0 AS alignment_gap FROM sim WHERE source_mode = 'PPL' AND target_mode = 'XPL'""")
def alignment_gap(spark, sf_dir):
    return rounded(vectors.alignment_gap(vectors.prototype_similarity(vectors.prototypes(idx(spark, sf_dir)))))


@query(f"""WITH {IDX}, {PROTO} SELECT source_mode, source_class, {', '.join(f"round(max(CASE WHEN target_class = 'class{k}' THEN cosine_similarity END), 6) + 0 AS class{k}" for k in range(4))} FROM sim WHERE target_mode = 'XPL' GROUP BY ALL""")
def similarity_table(spark, sf_dir):
    return rounded(vectors.similarity_table(vectors.prototype_similarity(vectors.prototypes(idx(spark, sf_dir))).filter("target_mode = 'XPL'")))


@query(f"""WITH {IDX}, d AS (SELECT DISTINCT mode AS training_domain FROM idx UNION ALL SELECT 'PPL+XPL') SELECT DISTINCT training_domain, mode AS evaluation_mode, training_domain || ' → ' || mode AS scenario FROM d, idx""")
def scenarios(spark, sf_dir):
    rows = models.domains(idx(spark, sf_dir)).select("training_domain").distinct().join(idx(spark, sf_dir).select(F.col("mode").alias("evaluation_mode")).distinct(), how="cross")
    return evaluation.scenarios(rows)


GUESS = f"""{PROTO}, dots AS (SELECT i.vec_id, i.mode, i.class_name AS true_class, p.class_name AS predicted_class, sum(p.x * i.x) AS s FROM (SELECT vec_id, mode, class_name, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM idx WHERE split <> 'train') i
JOIN proto p ON p.mode = i.mode AND p.pos = i.pos GROUP BY ALL), guess AS (SELECT vec_id, mode, true_class, predicted_class FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, predicted_class) AS r FROM dots) WHERE r = 1)"""


def prototype_guesses(spark, sf_dir):
    """Nearest-prototype classes of val and test rows: a classifier that SQL can express too."""
    rows = idx(spark, sf_dir)
    protos = vectors.prototypes(rows).groupBy("mode", "class_name").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")).select("mode", F.col("class_name").alias("predicted_class"), F.col("p.x").alias("p"))
    dot = F.aggregate(F.zip_with("embedding", "p", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    best = F.min_by("predicted_class", F.struct(-F.round(dot, 9), "predicted_class"))
    return rows.filter("split <> 'train'").join(protos, "mode").groupBy("vec_id", "mode", F.col("class_name").alias("true_class")).agg(best.alias("predicted_class"))


@query(f"WITH {IDX}, {GUESS}, l AS (SELECT true_class AS c FROM guess UNION SELECT predicted_class FROM guess) SELECT g.mode, a.c AS true_class, b.c AS predicted_class, (SELECT count(*) FROM guess x WHERE x.mode = g.mode AND x.true_class = a.c AND x.predicted_class = b.c) AS n FROM (SELECT DISTINCT mode FROM guess) g, l a, l b")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(prototype_guesses(spark, sf_dir), ["mode"])


@query(f"""WITH {IDX}, {GUESS}, s AS (SELECT mode, true_class AS c, 1 AS t, 0 AS p, CAST(true_class = predicted_class AS INT) AS tp FROM guess UNION ALL SELECT mode, predicted_class, 0, 1, 0 FROM guess),
per AS (SELECT mode, c, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM s GROUP BY ALL)
SELECT mode, round(sum(tp) / sum(t), 6) AS accuracy, round(avg(CASE WHEN t > 0 THEN tp / t END), 6) AS balanced_accuracy, round(avg(CASE WHEN t + p > 0 THEN 2 * tp / (t + p) ELSE 0 END), 6) AS macro_f1, CAST(sum(t) AS BIGINT) AS samples FROM per GROUP BY mode""")
def probe_metrics(spark, sf_dir):
    return rounded(evaluation.probe_metrics(prototype_guesses(spark, sf_dir), ["mode"]))


GRID = "grid AS (SELECT label % 4 AS g, CAST(power(10, vec_id % 4 - 2) AS DOUBLE) AS c, CAST((vec_id * 7 + label) % 5 AS DOUBLE) / 4 AS score, vec_id FROM embeddings)"


def grid(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("g"), F.pow(F.lit(10.0), F.col("vec_id") % 4 - 2).alias("c"), (((F.col("vec_id") * 7 + F.col("label")) % 5).cast("double") / 4).alias("score"), "vec_id")


@query(f"WITH {GRID}, m AS (SELECT g, c, avg(score) AS s FROM grid GROUP BY ALL) SELECT g, c AS selected_c, round(s, 6) AS mean_score FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, c) AS r FROM m) WHERE r = 1")
def select_best_c(spark, sf_dir):
    return rounded(evaluation.select_best(grid(spark, sf_dir), ["g"]))


@query(f"""WITH {IDX} SELECT r.repeat, mode, sample_id, CAST((row_number() OVER (PARTITION BY mode, r.repeat ORDER BY class_name, sha256(concat_ws('|', '42', CAST(r.repeat AS VARCHAR), sample_id)), sample_id) - 1) % 5 AS INT) AS fold FROM idx, (VALUES (0), (1)) r(repeat) WHERE split <> 'test'""")
def fold_assignment(spark, sf_dir):
    return evaluation.fold_assignment(idx(spark, sf_dir).filter("split <> 'test'"), 5, 2, 42).select("repeat", "mode", "sample_id", "fold")


@query(f"""WITH {IDX}, s AS (SELECT mode, class_name, count(*) AS n FROM idx GROUP BY ALL) SELECT mode, min(n) AS least, max(n) AS most, min(n) >= 5 AND min(n) - ceil(max(n) / 5) >= 3 AS feasible FROM s GROUP BY mode""")
def fold_feasibility(spark, sf_dir):
    return contracts.fold_feasibility(idx(spark, sf_dir), 5, 3)


@query(f"""WITH {GRID}, f AS (SELECT g, c, avg(score) AS macro_f1 FROM grid GROUP BY g, c, vec_id % 25) SELECT g, count(*) AS runs, round(median(c), 6) AS median_selected_c, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_samp(macro_f1), 6) AS macro_f1_std, round(min(macro_f1), 6) AS macro_f1_min, round(max(macro_f1), 6) AS macro_f1_max FROM f GROUP BY g""")
def stability_summary(spark, sf_dir):
    f = grid(spark, sf_dir).groupBy("g", F.col("c").alias("selected_c"), (F.col("vec_id") % 25).alias("fold")).agg(F.avg("score").alias("macro_f1"))
    return rounded(evaluation.stability_summary(f, ["macro_f1"], ["g"]))


@query(f"""WITH {GRID} SELECT g, quantile_cont(score, 0) AS low, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3, quantile_cont(score, 1) AS high FROM grid GROUP BY g""")
def five_numbers(spark, sf_dir):
    return evaluation.five_numbers(grid(spark, sf_dir), ["g"], "score")


AGREE = f"""cell AS (SELECT class_name AS a, k AS b, count(*)::DOUBLE AS n FROM (SELECT class_name, label // 3 AS k FROM idx) GROUP BY ALL), ra AS (SELECT a, sum(n) AS m FROM cell GROUP BY a), rb AS (SELECT b, sum(n) AS m FROM cell GROUP BY b), t AS (SELECT sum(n) AS t FROM cell),
pa AS (SELECT sum(m * (m - 1) / 2) AS p, -sum(m / t * ln(m / t)) AS h FROM ra, t), pb AS (SELECT sum(m * (m - 1) / 2) AS p, -sum(m / t * ln(m / t)) AS h FROM rb, t),
mi AS (SELECT sum(n / t * ln(n * t / (ra.m * rb.m))) AS mi, sum(n * (n - 1) / 2) AS joint FROM cell JOIN ra USING (a) JOIN rb USING (b), t)"""


@query(f"WITH {IDX}, {AGREE} SELECT round((joint - pa.p * pb.p / (t * (t - 1) / 2)) / ((pa.p + pb.p) / 2 - pa.p * pb.p / (t * (t - 1) / 2)), 6) + 0 AS ari, round(mi / ((pa.h + pb.h) / 2), 6) + 0 AS nmi FROM mi, pa, pb, t")
def clustering_agreement(spark, sf_dir):
    rows = idx(spark, sf_dir).withColumn("k", F.floor(F.col("label") / 3))
    return rounded(evaluation.clustering_agreement(rows, "class_name", "k"))


@query(f"""WITH {IDX}, d AS (SELECT a.vec_id, a.label AS c, b.label AS o, avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d FROM idx a JOIN idx b ON a.vec_id <> b.vec_id GROUP BY ALL),
ab AS (SELECT vec_id, c, max(CASE WHEN c = o THEN d END) AS a, min(CASE WHEN c <> o THEN d END) AS b FROM d GROUP BY ALL), s AS (SELECT c, coalesce((b - a) / greatest(a, b), 0) AS s FROM ab)
SELECT c AS cluster, count(*) AS n, round(avg(s), 6) + 0 AS silhouette FROM s GROUP BY c""")
def silhouette(spark, sf_dir):
    rows = idx(spark, sf_dir).withColumn("embedding_row", F.col("vec_id"))
    return rounded(models.silhouette(rows, "label").groupBy("cluster").agg(F.count("*").alias("n"), F.avg("silhouette").alias("silhouette")))


def numbered_idx(spark, sf_dir):
    return idx(spark, sf_dir).withColumn("embedding_row", F.col("vec_id"))


#: As configured in the reference.
C_VALUES = [0.01, 0.1, 1.0, 10.0, 100.0]


@query()
def linear_probe(spark, sf_dir):
    return rounded(models.linear_probes(numbered_idx(spark, sf_dir), C_VALUES)[0])


@query()
def repeated_probe(spark, sf_dir):
    return rounded(evaluation.stability_summary(models.repeated_probes(numbered_idx(spark, sf_dir), C_VALUES, outer=5, repeats=5, inner=3)))


@query()
def kmeans(spark, sf_dir):
    """Agreement of the clusters with classes and with modes, and their mean silhouette."""
    found = models.kmeans(numbered_idx(spark, sf_dir), 4, seeds=50).persist()
    by = [evaluation.clustering_agreement(found, c, "kmeans_cluster").withColumn("target", F.lit(c)) for c in ("class_name", "mode")]
    mean = models.silhouette(found, "kmeans_cluster").agg(F.avg("silhouette").alias("mean_silhouette"))
    out = rounded(by[0].unionByName(by[1]).join(mean, how="cross")).toPandas()  # two rows
    found.unpersist()
    return spark.createDataFrame(out)


@query()
def pca(spark, sf_dir):
    points, variance = models.pca(numbered_idx(spark, sf_dir))
    return rounded(points.select("vec_id", "pca_1", "pca_2", F.lit(sum(variance)).alias("explained_variance")))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
