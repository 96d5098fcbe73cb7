from types import SimpleNamespace

import pytest

from tallyflow.sources.shared import hinted, is_small, new_path, release, removed_at_exit, shared_folder, written


def session(master, where=None):
    """What shared_folder asks of a session."""
    conf = {"spark.checkpoint.dir": where} if where else {}
    told = SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__)
    return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: told, master=master), conf=told)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        shared_folder(session(master))
    assert shared_folder(session(master, "hdfs://h/checkpoints/")) == "hdfs://h/checkpoints"


def test_a_local_session_takes_a_temporary_folder():
    s = session("local[4]")
    assert shared_folder(s) == shared_folder(s) and "tallyflow-" in shared_folder(s)


def test_written_tables(spark):
    df = written(spark.range(10).toDF("n"), "numbers")
    assert sorted(r.n for r in df.collect()) == list(range(10))
    assert is_small(df, 10) and not is_small(df, 9)
    assert "broadcast" in hinted(df, 10)._jdf.queryExecution().logical().toString().lower() and "broadcast" not in hinted(df, 9)._jdf.queryExecution().logical().toString().lower()


def test_few_rows_of_many_bytes_are_not_broadcast(spark):
    rows = [(1, "x" * 1000, ["ab"] * 50, {"k": "v" * 100}, (2, "y" * 200)), (2, None, None, None, None), (3, "é" * 500, [None, "c"], {}, (None, None))]
    df = written(spark.createDataFrame(rows, "n long, text string, list array<string>, map map<string, string>, inner struct<a: int, b: string>"), "wide")
    least, most = 3 * 8 + 1000 + 1000 + 50 * 2 + 1 + 100 + 200, 4000  # what the values take, and with some bytes for each beside
    assert is_small(df, 3, most) and not is_small(df, 3, least) and not is_small(df, 2, most)
    assert is_small(df.limit(0), 0, 0)
    assert "broadcast" not in hinted(df, 3, least)._jdf.queryExecution().logical().toString().lower()


def test_tables_are_deleted_when_the_application_ends(spark):
    path = new_path(spark, "numbers")
    spark.range(3).write.parquet(path)
    assert removed_at_exit(spark, path) == path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(place) and files.cancelDeleteOnExit(place)
    removed_at_exit(spark, path)


def test_release(spark):
    table = written(spark.range(5).toDF("n"), "numbers", compression="zstd")
    (folder,) = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    release(table)
    assert not files.exists(place)
    with pytest.raises(ValueError):
        release(spark.read.parquet("/root/testdata/sf0.001/nation.parquet"))
