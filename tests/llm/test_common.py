"""Folders and settings that the operators share."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from curaspark.llm import common


def session(master, named=None):
    at = [None]
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: at[0], setCheckpointDir=lambda d: at.__setitem__(0, d))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))


def test_shared_folder_is_never_one_machines_own_on_a_cluster():
    assert common.shared_folder(session("yarn", "hdfs://store/shared/")) == "hdfs://store/shared"
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(session(master))
    one = session("local[4]")
    assert common.shared_folder(one) == common.shared_folder(one) == one.sparkContext.getCheckpointDir()


def test_what_is_cut_can_be_removed(spark):
    df = common.cut(spark.range(5))
    kept = common.stash(spark.range(3), "three")
    folders = common.files(df)
    assert folders <= common.written() and df.count() == 5 and kept.count() == 3
    common.drop(df)
    assert not folders & common.written()
    before = common.written()
    common.clean(spark)
    assert before and not common.written()


def test_small_batches_do_not_touch_the_callers_session(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    @F.pandas_udf("int")
    def rows(x):
        return x * 0 + len(x)

    df = common.in_small_batches(spark.range(2000).repartition(1)).withColumn("n", rows.asNondeterministic()("id"))
    assert spark.conf.get(key) == before and {r.n for r in df.collect()} == {int(common.BATCH_ROWS)}


def test_marks_leave_no_value_out(spark):
    keys = spark.range(5000).select("id", F.when(F.col("id") % 50 > 0, F.xxhash64("id")).alias("k"))
    wanted = keys.filter("id % 7 = 0").select("k")
    got = common.mark(keys, F.col("k"), wanted, "k", "may")
    assert got.count() == 5000 and got.filter("id % 7 = 0 and k is not null and not may").count() == 0
    assert got.filter("may").count() < 900 and got.filter("k is null and may").count() == 0
    assert common.mark(keys, F.col("k"), wanted.limit(0), "k", "may").filter("may").count() == 0


def test_files_are_whole(tmp_path):
    at = f"file:{tmp_path}/a"
    common.write_file(f"{at}/0", b"12")
    common.write_file(f"{at}/0", b"123")
    assert common.read_file(f"{at}/0") == b"123" == common.map_file(f"{at}/0").to_pybytes()
    assert common.list_files(at) == ["0"] and common.list_files(f"{at}-none") == []
    assert common.read_file(f"{at}/1") is None and common.map_file(f"{at}/1") is None
    assert common.local_path("hdfs://x/y") is None and common.local_path("file:///a/b") == common.local_path("file:/a/b") == "/a/b"
