import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark import schemas
from curaspark.functions import scalar
from curaspark.operators import catalog, contracts, evaluation, integrity, models, quality, selection, vectors
from curaspark.operators.contracts import ContractError
from curaspark.sources import archive, images, tables
from curaspark.streaming import watch


def png(pixels: np.ndarray) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def entries(spark, ids, modes=("PPL", "XPL"), splits=("train", "val", "test"), classes=("class10", "class13")):
    rows = [(f"root/{m}-1223/{s}/{c}/{i}.jpg", 100, 80) for m in modes for s in splits for c in classes for i in ids(m, s)]
    return spark.createDataFrame(rows, "member_path string, file_size long, compress_size long")


def classes(spark):
    return spark.createDataFrame([("class10", "Cemented fracture"), ("class13", "Micritic limestone")], "class_id string, class_label string")


def test_archive_parser(spark):
    e = spark.createDataFrame([("root/PPL-1223/train/CLASS10/a.1.JPG", 1, 1), ("root/PPL-1223/train/class10/b_ars.jpg", 1, 1), ("root/PPL-1223/train/class99/c.jpg", 1, 1), ("x/root/PPL-1223/train/class10/d.jpg", 1, 1), ("root/XPL-1223/val/class13/e.tif", 1, 1)], "member_path string, file_size long, compress_size long")
    got = {(r.mode, r.split, r.class_id, r.sample_id) for r in selection.parse_archive(e, classes(spark), "/root/").collect()}
    assert got == {("PPL", "train", "class10", "a.1"), ("XPL", "val", "class13", "e")}


def test_reserved_ids_and_order_independence(spark):
    rows = spark.createDataFrame([("PPL", "class10", s, f"sample.{i}") for s, n in (("train", 2), ("val", 4)) for i in range(n)], "mode string, class_id string, split string, sample_id string")
    got = selection.select_images(rows, rows, {"val": 2, "train": 2}, 42).collect()
    assert {(r.split, r.sample_id) for r in got} == {("train", "sample.0"), ("train", "sample.1"), ("val", "sample.2"), ("val", "sample.3")}
    again = selection.select_images(rows.orderBy(F.desc("sample_id")), rows, {"train": 2, "val": 2}, 42).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}
    with pytest.raises(contracts.ContractError, match="not enough"):
        selection.select_images(rows, rows, {"train": 3}, 42)


def test_pairs(spark):
    parsed = selection.parse_archive(entries(spark, lambda m, s: [f"id{k}" for k in range(4)]), classes(spark), "root")
    pairs = selection.select_pairs(selection.exact_pairs(parsed), {"train": 2, "val": 1, "test": 1}, 7)
    assert pairs.count() == 8 and pairs.agg(F.sum(F.col("ppl.file_size") + F.col("xpl.file_size"))).first()[0] == 1600
    with pytest.raises(contracts.ContractError):
        selection.exact_pairs(parsed.unionByName(parsed))


def test_contracts(spark):
    rows = spark.createDataFrame([("a", "PPL", "c", "train"), ("a", "PPL", "c", "val"), ("b", "PPL", "c", "train")], "sample_id string, mode string, class_name string, split string")
    with pytest.raises(contracts.ContractError, match="several splits"):
        contracts.disjoint_splits(rows)
    assert contracts.conflicting_rows(rows).count() == 2
    contracts.disjoint_splits(rows.limit(0))
    h = spark.createDataFrame([("0" * 64, "x"), ("0" * 64, "y")], "sha256 string, archive_member string")
    with pytest.raises(contracts.ContractError, match="repeated"):
        contracts.unique_hashes(h)
    with pytest.raises(contracts.ContractError, match="sha256"):
        contracts.unique_hashes(h.withColumn("sha256", F.lit("zz")))
    with pytest.raises(contracts.ContractError):
        contracts.c_grid([])
    bad = spark.createDataFrame([(0, [1.0]), (2, [1.0])], "embedding_row long, embedding array<float>")
    with pytest.raises(contracts.ContractError):
        contracts.aligned(bad)


def test_scalars(spark):
    r = spark.range(1).select(scalar.stem(F.lit("Oolitic.20.jpg")).alias("a"), scalar.suffix(F.lit("x/Y.TIF")).alias("b"), scalar.slug(F.lit("Class10"), F.lit(" Cemented  fracture! ")).alias("c"), scalar.strict_boolean(F.lit(" TRUE ")).alias("d"), scalar.human_size(F.lit(1536)).alias("e"), scalar.hamming(F.lit(5), F.lit(6)).alias("f")).first()
    assert tuple(r) == ("Oolitic.20", ".tif", "class10_cemented_fracture", True, "1.5 KB", 2)
    with pytest.raises(Exception, match="not a boolean"):
        spark.range(1).select(scalar.strict_boolean(F.lit("yes"))).collect()
    with pytest.raises(Exception, match="unsafe"):
        spark.range(1).select(scalar.safe_relative_path(F.lit("m"), F.lit("s"), F.lit("c"), F.lit("../x"))).collect()


def test_images_catalog_and_quality(spark, tmp_path):
    grid = np.zeros((64, 64), np.uint8)
    grid[8:28, 10:30], grid[36:55, 35:58] = 220, 130
    for path, x in (("PPL/train/c/a.png", grid), ("PPL/val/c/b.png", grid), ("XPL/train/c/a.png", np.full((32, 32), 100, np.uint8))):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(png(x))
    (tmp_path / "XPL/train/c/broken.png").write_bytes(b"no image")
    cat = catalog.build_catalog(spark, str(tmp_path), ["PPL", "XPL"], ["train", "val"], ["png"])
    assert cat.count() == 4 and catalog.modality_pairs(cat).filter("has_pair").count() == 1
    pics = images.read_images(spark, str(tmp_path))
    limits = {"min_brightness": 35, "max_brightness": 220, "min_contrast": 18, "min_sharpness": 60}
    report = {(r.mode, r.split, r.sample_id): r for r in quality.evaluate_catalog(cat, pics, limits).collect()}
    assert report["XPL", "train", "a"].quality_flags == "baixo_contraste;possivel_desfoque"
    assert report["XPL", "train", "broken"].automatic_status == "read_error" and report["XPL", "train", "broken"].brightness is None
    hashed = integrity.hash_images(pics).join(cat, "path").select(F.col("path").alias("row_id"), "mode", F.col("class_name").alias("class_id"), "split", "sample_id", F.col("path").alias("archive_member"), "phash")
    pairs = integrity.near_duplicates(hashed, 0).collect()
    assert [(r.sample_id_a, r.sample_id_b, r.distance) for r in pairs] == [("a", "b", 0)]
    review = spark.createDataFrame([("PPL", "c", "train", "a", "val", "b", "distinct_keep", "n")], "mode string, class_id string, split_a string, sample_id_a string, split_b string, sample_id_b string, decision string, notes string")
    assert integrity.apply_near_duplicate_reviews(integrity.near_duplicates(hashed, 0), review).first().decision == "distinct_keep"
    index = vectors.number_inputs(cat.filter("sample_id <> 'broken'"))
    emb = vectors.embed_images(index, pics)
    contracts.aligned(emb)
    tables.save_embeddings(emb, str(tmp_path / "e"))
    assert tables.load_embeddings(spark, str(tmp_path / "e")).count() == 3


def test_banded_pairs_equal_all_pairs(spark):
    r = np.random.default_rng(1)
    base = int(r.integers(0, 1 << 62))
    rows = [(i, "m", "c", ("train", "val")[i % 2], str(i), str(i), base ^ sum(1 << int(b) for b in r.choice(62, r.integers(0, 5), replace=False))) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, mode string, class_id string, split string, sample_id string, archive_member string, phash long")
    want = {(str(a[0]), str(b[0])) for a in rows for b in rows if a[0] < b[0] and a[3] != b[3] and bin(a[6] ^ b[6]).count("1") <= 4}
    assert {(x.sample_id_a, x.sample_id_b) for x in integrity.near_duplicates(df, 4).collect()} == want


def test_reviews_and_summary(spark):
    report = spark.createDataFrame([("PPL", "train", "c", "a", "p", False, "", 1.0, float("nan"), 2.0), ("PPL", "train", "c", "b", "q", True, "", 3.0, 1.0, 2.0)], "mode string, split string, class_name string, sample_id string, path string, automatic_quality_ok boolean, read_error string, brightness double, contrast double, sharpness double")
    reviews = spark.createDataFrame([("PPL", "train", "c", "a", "keep", "fine"), ("PPL", "train", "c", "z", "exclude", "")], "mode string, split string, class_name string, sample_id string, manual_decision string, review_notes string")
    done = quality.apply_manual_reviews(report, reviews)
    assert {r.sample_id: (r.final_status, r.use_for_model) for r in done.collect()} == {"a": ("manual_keep", True), "b": ("automatic_pass", True)}
    s = quality.summarise_quality(done).first()
    assert (s.images, s.manual_keep, s.mean_contrast, s.acceptance_rate) == (2, 1, 1.0, 1.0)
    with pytest.raises(contracts.ContractError, match="unknown decisions"):
        quality.apply_manual_reviews(report, reviews.withColumn("manual_decision", F.lit("maybe")))


def bimodal(spark):
    r = np.random.default_rng(42)
    rows = []
    for m, mode in enumerate(("PPL", "XPL")):
        for c in range(4):
            for k, split in enumerate(["train"] * 3 + ["val"] * 2 + ["test"] * 2):
                v = r.normal(0, 0.03, 8)
                v[c] += 4
                v[4 + m] += 0.15
                rows.append((len(rows), f"{mode}{c}{k}", mode, split, f"class{c}", (v / np.linalg.norm(v)).tolist()))
    return spark.createDataFrame(rows, "embedding_row long, sample_id string, mode string, split string, class_name string, embedding array<double>")


def test_probes_prototypes_and_clusters(spark):
    index = bimodal(spark)
    contracts.complete_classes(index)
    metrics, predictions = models.linear_probes(index, [0.1, 1.0])
    m = metrics.collect()
    assert len(m) == 6 and all(r.macro_f1 == 1.0 and r.selected_c == 0.1 for r in m) and predictions.count() == 48
    gap = vectors.alignment_gap(vectors.prototype_similarity(vectors.prototypes(index))).first()
    assert gap.alignment_gap > 0.9
    found = models.kmeans(index, 4, seeds=5)
    assert evaluation.clustering_agreement(found, "class_name", "kmeans_cluster").first().ari == pytest.approx(1.0)
    assert models.silhouette(found, "kmeans_cluster", block=8).agg(F.avg("silhouette")).first()[0] > 0.8
    points, variance = models.pca(index)
    assert points.count() == 56 and 0 < sum(variance) <= 1.0001


def test_repeated_probes_never_read_test_rows(spark):
    index = bimodal(spark)
    poisoned = index.withColumn("embedding", F.when(F.col("split") == "test", F.transform("embedding", lambda x: F.lit(float("nan")))).otherwise(F.col("embedding")))
    folds = models.repeated_probes(poisoned, [1.0], outer=2, repeats=2, inner=2)
    assert folds.count() == 24 and evaluation.stability_summary(folds).count() == 6
    with pytest.raises(contracts.ContractError):
        models.repeated_probes(index, [1.0], outer=6, repeats=2, inner=2)


def test_zip_source_download_and_quarantine(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/a.jpg", b"1" * 100)
    rows = archive.zip_index(spark, str(tmp_path / "a.zip"))
    got = archive.download(rows.withColumn("local_relative_path", F.lit("p/a.jpg")), str(tmp_path / "a.zip"), str(tmp_path / "out")).first()
    assert got.bytes == 100 and (tmp_path / "out/p/a.jpg").exists()
    assert archive.quarantine(["p/a.jpg"], str(tmp_path / "out"), str(tmp_path / "q")) == ["p/a.jpg"]
    assert [archive.retry_delay(k, 2.0) for k in (1, 2, 9)] == [2.0, 4.0, 30.0]
    with pytest.raises(OSError):
        archive.fetch(lambda m: open(tmp_path / "none", "rb"), "m", 1, tmp_path / "t", 2, 0.0)
    assert not (tmp_path / "t.part").exists()


def two_modes(n=12, seed=3):
    """Rows of two modes and three classes whose vectors tell the classes apart."""
    r = np.random.default_rng(seed)
    rows = []
    for m, mode in enumerate(("PPL", "XPL")):
        for c in range(3):
            for i in range(n):
                x = r.normal(0, 0.03, 6)
                x[c] += 4.0
                x[4 + m] += 0.15
                split = "train" if i < n // 2 else "val" if i < 3 * n // 4 else "test"
                rows.append((len(rows), f"{mode}{c}{i}", mode, split, f"class{c}", (x / np.linalg.norm(x)).tolist()))
    return rows


INDEX = "embedding_row long, sample_id string, mode string, split string, class_name string, embedding array<double>"


def test_probes_need_every_class(spark):
    rows = two_modes()
    metrics, predictions = models.linear_probes(spark.createDataFrame(rows, INDEX), [0.1, 1.0])
    got = metrics.collect()
    assert len(got) == 6 and all(r.macro_f1 == 1.0 for r in got) and predictions.count() == 6 * 9
    for gone in ("val", "test"):
        with pytest.raises(ContractError, match="classes missing"):
            models.linear_probes(spark.createDataFrame([r for r in rows if not (r[3] == gone and r[2] == "XPL" and r[4] == "class1")], INDEX), [1.0])
    with pytest.raises(ContractError, match="modes"):
        models.linear_probes(spark.createDataFrame([r for r in rows if r[2] == "PPL"], INDEX), [1.0])


@pytest.mark.skipif("SLOW_TESTS" not in os.environ, reason="some minutes; set SLOW_TESTS")
def test_repeated_probes_agree_with_the_distributed_form(spark):
    index = spark.createDataFrame(two_modes(), INDEX)
    local = models.repeated_probes(index, [1.0], outer=3, repeats=1, inner=2).collect()
    spread = models.repeated_probes(index, [1.0], outer=3, repeats=1, inner=2, local_rows=5).collect()
    keys = [(r.training_domain, r.evaluation_mode, r.outer_repeat, r.outer_fold) for r in local]
    assert keys == sorted(keys) == [(r.training_domain, r.evaluation_mode, r.outer_repeat, r.outer_fold) for r in spread] and len(keys) == 18
    for a, b in zip(local, spread):
        assert (a.fit_samples, a.evaluation_samples, a.relation, a.macro_f1) == (b.fit_samples, b.evaluation_samples, b.relation, b.macro_f1)


def test_repeated_probes(spark):
    index = spark.createDataFrame(two_modes(), INDEX)
    got = models.repeated_probes(index, [0.1, 1.0], outer=3, repeats=2, inner=2).collect()
    assert len(got) == 36 and all(r.macro_f1 == 1.0 for r in got if r.relation != "cross_domain")
    with pytest.raises(ContractError):
        models.repeated_probes(index, [1.0], outer=10, repeats=1, inner=2)


def test_kmeans_has_the_least_cost_of_its_starts(spark):
    rows = two_modes(20)
    found = models.kmeans(spark.createDataFrame(rows, INDEX), 3, seeds=6).collect()
    by = {}
    for r in found:
        by.setdefault(r.class_name, set()).add(r.kmeans_cluster)
    assert sorted(len(v) for v in by.values()) == [1, 1, 1] and len(set.union(*by.values())) == 3
    with pytest.raises(ContractError):
        models.kmeans(spark.createDataFrame(rows[:2], INDEX), 3, seeds=2)


def test_embedding_needs_every_image(spark):
    pixels = np.random.default_rng(0).integers(0, 255, (16, 16, 3), np.uint8)
    images = spark.createDataFrame([("a.png", 16, 16, 3, bytearray(pixels.tobytes())), ("bad.png", -1, -1, -1, bytearray())], "path string, height int, width int, nChannels int, data binary")
    index = [(0, "a", "PPL", "train", "c", "a.png"), (1, "b", "PPL", "train", "c", "bad.png"), (2, "d", "PPL", "train", "c", "none.png")]
    kind = "embedding_row long, sample_id string, mode string, split string, class_name string, path string"

    def colours(batch):
        return np.array([x.reshape(-1, 3).mean(0) for x in batch], np.float32)

    got = vectors.embed_images(spark.createDataFrame(index[:1], kind), images, colours).first()
    assert got.embedding == pytest.approx(pixels.reshape(-1, 3).mean(0)[::-1], abs=1e-3)  # BGR becomes RGB
    for row in index[1:]:
        with pytest.raises(Exception, match="no image"):
            vectors.embed_images(spark.createDataFrame([row], kind), images, colours).collect()
    with pytest.raises(ContractError):
        vectors.embed_images(spark.createDataFrame(index, kind), images, colours, batch_size=0)
    assert len(vectors.embed_images(spark.createDataFrame(index[:1], kind), images).first().embedding) == 384


def test_reviews_join_nulls(spark):
    pairs = "mode string, class_id string, split_a string, sample_id_a string, split_b string, sample_id_b string"
    report = spark.createDataFrame([("PPL", None, "train", "1", "val", "2", 3), ("PPL", "c", "train", "1", "val", "2", 3)], pairs + ", distance int")
    reviews = spark.createDataFrame([("PPL", None, "train", "1", "val", "2", "distinct_keep", "seen")], pairs + ", decision string, notes string")
    got = {r.class_id: r.decision for r in integrity.apply_near_duplicate_reviews(report, reviews).collect()}
    assert got == {None: "distinct_keep", "c": "pending_review"}


def test_gates(spark):
    pairs = spark.createDataFrame([("distinct_keep",)], "decision string")
    report = spark.createDataFrame([(True,), (False,), (True,)], "use_for_model boolean")
    contracts.ready_for_embedding(pairs, report, 2)
    with pytest.raises(ContractError, match="without a decision"):
        contracts.ready_for_embedding(spark.createDataFrame([("pending_review",)], "decision string"), report, 2)
    with pytest.raises(ContractError, match="2 accepted"):
        contracts.ready_for_embedding(pairs, report, 3)


def test_orders(spark):
    rows = [("b.2", "PPL", "train", "c", "p1"), ("B.1", "XPL", "train", "c", "p2"), ("b.1", "PPL", "train", "c", "p3"), ("B.2", "XPL", "train", "c", "p4")]
    df = spark.createDataFrame(rows, "sample_id string, mode string, split string, class_name string, path string")
    assert [r.sample_id for r in selection.exact_pairs(df, "class_name").collect()] == ["b.1", "b.2"]
    assert [r.sample_id for r in catalog.pair_table(df).collect()] == ["B.1", "B.2", "b.1", "b.2"]
    old = spark.createDataFrame([("z",), ("a",), ("",)], "member_path string")
    assert [r[0] for r in selection.stale_members(old, old.limit(0)).collect()] == ["a", "z"]
    with pytest.raises(ContractError, match="not in the archive"):
        selection.stale_members(old, old.limit(0), old.filter("member_path = 'a'"))
    assert [r.member_path for r in selection.missing_exclusions(old.filter("member_path = 'a'"), old).orderBy("member_path").collect()] == ["", "z"]


def test_report_files(spark, tmp_path):
    tables.save_json({"b": 1, "a": "é"}, str(tmp_path / "x/run.json"))
    assert (tmp_path / "x/run.json").read_text(encoding="utf-8") == '{\n  "a": "é",\n  "b": 1\n}\n' and not list((tmp_path / "x").glob("*.part"))
    copied = tables.copy_result(spark, str(tmp_path / "x/run.json"), str(tmp_path / "results"))
    assert copied.endswith("results/run.json") and (tmp_path / "results/run.json").exists()
    df = spark.createDataFrame([("a", 0.5, None)], "k string, v double, n int")
    assert tables.markdown_table(df) == "| k | v | n |\n| --- | --- | --- |\n| a | 0.500 |  |"
    with pytest.raises(ValueError):
        tables.markdown_table(df, most=0)
    (tmp_path / "c.json").write_text('{"paths": {}, "data": {}, "quality": {"min_contrast": 18}}')
    assert tables.load_config(str(tmp_path / "c.json"))["quality"] == {"min_contrast": 18}
    (tmp_path / "d.json").write_text('{"paths": {}}')
    with pytest.raises(ContractError, match="data, quality"):
        tables.load_config(str(tmp_path / "d.json"))
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ContractError, match="mapping"):
        tables.load_config(str(tmp_path / "e.json"))
    with pytest.raises(FileNotFoundError):
        tables.load_config(str(tmp_path / "none.json"))
    about = tables.provenance(spark, {"config": str(tmp_path / "c.json")}, seed=42)
    assert len(about["config_sha256"]) == 64 and about["spark_version"] == spark.version and about["seed"] == 42


def test_manifest_is_replaced_whole(spark, tmp_path):
    names = schemas.MANIFEST.names
    good = {n: "1" for n in names} | {"sha256": "a" * 64, "mode": "PPL", "class_id": "c", "sample_id": "s", "split": "train", "archive_member": "m,1", "bytes": 3}
    path = str(tmp_path / "manifest.csv")
    kind = ", ".join(f"{n} {'long' if n == 'bytes' else 'string'}" for n in names if n != "dataset_doi")

    def frame(rows):
        return spark.createDataFrame([tuple(r[n] for n in names if n != "dataset_doi") for r in rows], kind)

    tables.write_manifest(frame([good]), path, "10.1/x")
    assert (tmp_path / "manifest.csv").is_file() and not (tmp_path / "manifest.csv.part").exists()
    first = (tmp_path / "manifest.csv").read_text()
    assert first.splitlines()[0] == ",".join(names) and '"m,1"' in first
    assert [r.member_path for r in tables.previous_members(spark, path).collect()] == ["m,1"]
    for bad in ([good, good | {"archive_member": "n"}], [good | {"sha256": "x"}], [good, good | {"sha256": "b" * 64, "split": "VAL "}]):
        with pytest.raises(ContractError):
            tables.write_manifest(frame(bad), path, "10.1/x")
    assert (tmp_path / "manifest.csv").read_text() == first


def test_files_are_watched(spark, tmp_path):
    (tmp_path / "in/PPL/train/c").mkdir(parents=True)
    (tmp_path / "in/PPL/train/c/a.png").write_bytes(b"123")
    (tmp_path / "in/PPL/train/c/b.txt").write_bytes(b"1")
    query = watch.watch_files(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("watched").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(60)
    got = spark.table("watched").collect()
    assert [r.length for r in got] == [3] and got[0].path.endswith("a.png")


def plain_silhouette(x, c):
    """embedding_row to silhouette by all distances."""
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        near = {k: d[c == k].sum() / max(1, (c == k).sum() - (k == c[i])) for k in set(c)}
        a, b = near.pop(c[i]), min(near.values())
        out[i] = 0.0 if (c == c[i]).sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b)
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_silhouette_by_strips_equals_all_distances(spark, kind):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (90, 5)).astype(np.float32).astype(float) + (1000.0 if kind == "double" else 0)
    c = r.integers(0, 4, 90)
    x[20:50] = x[20]  # copies, in several clusters
    x[50:60] = x[20] + (r.integers(-4, 5, (10, 5)) * 2.0**-10)  # near copies
    c[89] = 9  # alone
    rows = [(i, int(c[i]), x[i].tolist()) for i in range(90)] + [(90, None, x[0].tolist()), (91, 1, None)]
    index = spark.createDataFrame(rows, f"embedding_row long, c int, embedding array<{kind}>")
    want = plain_silhouette(x, c) | {90: 0.0, 91: 0.0}
    for block in (7, 32, 1000):
        got = models.silhouette(index, "c", block=block).collect()
        assert {q.embedding_row: q.cluster for q in got} == {q[0]: q[1] for q in rows} and len(got) == 92
        assert {q.embedding_row: q.silhouette for q in got} == pytest.approx(want, abs=1e-12)
    assert models.silhouette(index.filter("c = 1"), "c").filter("silhouette <> 0").count() == 0


def test_silhouette_sums_of_many_copies():
    x = np.repeat(np.random.default_rng(1).normal(0, 1, (3, 4)), 120, 0)
    c = np.sort(np.arange(360) % 70).astype(np.int32)  # runs beyond 64
    (u, s), (v, t) = models._tile_sums(x, c, x[:300], c[:300], True)
    d = np.sqrt(((x[:, None] - x[None, :300]) ** 2).sum(2))
    assert s == pytest.approx(np.array([d[:, c[:300] == k].sum(1) for k in u]).T) and t == pytest.approx(np.array([d[c == k].sum(0) for k in v]).T)


def test_kmeans_rounds_add_up_every_row(spark):
    r = np.random.default_rng(2)
    x, centres = r.normal(0, 1, (3000, 5)), r.normal(0, 1, (7, 3, 5))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(2)
    sums, count, cost = models._kmeans_round(models._packed(rows), centres)
    d = ((x[:, None, None] - centres) ** 2).sum(3)
    at = d.argmin(2)
    assert cost == pytest.approx(d.min(2).sum(0)) and (count == np.array([np.bincount(a, minlength=3) for a in at.T])).all()
    assert sums == pytest.approx(np.array([[x[a == c].sum(0) for c in range(3)] for a in at.T]))


def test_softmax_reaches_its_optimum_on_chosen_rows_of_floats():
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (5000, 6)).astype(np.float32)
    y = (x[:, :3] + r.gumbel(0, 1, (5000, 3))).argmax(1) + 2
    at = np.flatnonzero(r.random(5000) < 0.9)
    for c in (0.01, 100.0):
        m = models.Softmax(c).fit(x, y, at=at)
        z = x[at].astype(float) @ m.w[:-1] + m.w[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        miss = p / p.sum(1, keepdims=True) - (y[at][:, None] == m.classes)
        assert np.abs(m.w[:-1] + c * x[at].astype(float).T @ miss).max() < 1e-5 and np.abs(c * miss.sum(0)).max() < 1e-5
        assert (m.predict(x, at) == m.classes[z.argmax(1)]).all()


def test_near_duplicates_of_blocks_equal_all_pairs(spark):
    r = np.random.default_rng(8)
    rows = []
    for i in range(150):
        split = [None, "train", "val", "test"][0 if i % 29 == 0 else 1 + i % 3]
        bits = None if i == 31 else int(r.integers(-(2**63), 2**63)) if i % 2 else -1 ^ (1 << int(r.integers(0, 63)))
        rows.append((f"r{i % 140:03}", "XPL" if i % 5 == 0 else "PPL", "c" if i % 7 else "d", split, f"s{i}", f"m{i}", bits))
    hashed = spark.createDataFrame(rows, "row_id string, mode string, class_id string, split string, sample_id string, archive_member string, phash long")
    want = set()
    for a in rows:
        for b in rows:
            if a[:1] < b[:1] and a[1:3] == b[1:3] and a[3] and b[3] and a[3] != b[3] and a[6] is not None and b[6] is not None:
                d = ((a[6] ^ b[6]) & (2**64 - 1)).bit_count()
                if d <= 28:
                    want.add((a[1], a[2], a[3], a[4], b[3], b[4], a[5], b[5], d))
    for block in (16, 8192):
        got = [tuple(q) for q in integrity._block_pairs(hashed.filter("split is not null and phash is not null"), 28, block).collect()]
        assert len(got) == len(want) > 500 and set(got) == want
    ordered = integrity.near_duplicates(hashed, 28)
    assert set(map(tuple, ordered.collect())) == want and ordered.columns[:6] == integrity.NEAR_DUPLICATE_KEY


def test_rows_of_a_fit_stay_floats():
    import pyarrow as pa

    def batch(x):
        return pa.RecordBatch.from_pydict({"y": list(range(len(x))), "embedding": pa.array(x, pa.list_(pa.float32()))})

    got = models._gathered(iter([batch([[1.0, 2.0]]), batch([]), batch([[3.0, 4.0], [5.0, 6.0]])]))
    assert got["embedding"].dtype == np.float32 and got["embedding"].tolist() == [[1, 2], [3, 4], [5, 6]] and got["y"].tolist() == [0, 0, 1]
    for bad in ([[1.0], [1.0, 2.0]], [[1.0, None]], [None], [[float("nan")]]):
        with pytest.raises(ContractError, match="finite"):
            models._gathered(iter([batch(bad)]))
    with pytest.raises(ContractError, match="finite"):
        models._gathered(iter([batch([[1.0]]), batch([[1.0, 2.0]])]))
