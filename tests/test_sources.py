"""Text parsing rules, round trips, generators, the stream and the command line."""

import sys
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.sources import hdf5, read_matrix, write_matrix
from gridloom.sources.random import normal, random_matrix, random_vector, uniform_int
from gridloom.streaming import windowed_row_params


def read(spark, path, **options):
    m = read_matrix(spark, str(path), **options)
    return m.columns, [(r["row_name"], r["values"]) for r in m.rows.orderBy("row_id").collect()]


def test_csv_rules(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b'\n\n,x,"y",x,z\r\nr0,1,,3,4\r\n\r\nr1,5\nr2,1,2,3,4,5,6\n"r,3",1.5abc, 2 ,nan\n')
    names, rows = read(spark, path)
    assert names == ["x", '"y"', "x", "z"]
    assert rows == [("r0", [1, 0, 3, 4]), ("r1", [5, 0, 0, 0]), ("r2", [1, 2, 3, 4]), ('"r', [3, 1.5, 2, 0])]
    assert read(spark, path, rows=2, cols=2) == (["x", '"y"'], [("r0", [1, 0]), ("r1", [5, 0])])
    assert read(spark, path, strict=True)[1][1] == ("r1", [5, None, None, None])
    with pytest.raises(ValueError, match="names 4 columns, not 9"):
        read(spark, path, cols=9)


def test_exp_rules(spark, tmp_path):
    path = tmp_path / "a.exp"
    path.write_text("Id\tAlias\ta\tb\n\nempty\nempty\ng0\t---\t1\t2\ng1\tx\t\t4\n")
    assert read(spark, path, skip=True) == (["a", "b"], [("g0", [1, 2]), ("g1", [0, 4])])
    assert len(read(spark, path)[1]) == 4
    path.write_text("Id\tAlias\ta\tb\n\nempty\n\ng0\t---\t1\t0x1p3\ng1\tx\t1e400\t4\n")
    assert read(spark, path, skip=True)[1] == [("g0", [1, 0]), ("g1", [1e308, 4])]
    path.write_bytes(b"Id\tAlias\ta\rg0\t---\t1\rg1\t---\t2\r")
    assert read(spark, path) == (["a"], [("g0", [1]), ("g1", [2])])
    m = read_matrix(spark, str(path))
    assert "Exchange hashpartitioning" not in m.rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).split("BroadcastExchange")[0]


@pytest.mark.parametrize("name", ["m.csv", "m.exp"])
@pytest.mark.parametrize("single", [False, True])
def test_round_trip(spark, tmp_path, name, single):
    m = random_matrix(spark, 50, 8, low=-1e-9, high=1e9).repartition(5)
    write_matrix(m, [f"c{i}" for i in range(8)], str(tmp_path / name), skip=True, single_file=single)
    names, rows = read(spark, tmp_path / name, skip=True)
    assert names == [f"c{i}" for i in range(8)]
    assert rows == [(r["row_name"], r["values"]) for r in m.orderBy("row_id").collect()]


def test_long_files_keep_their_order(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text(",v\n" + "".join(f"n{i},{i}\n" for i in range(30_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert read(spark, path)[1] == [(f"n{i}", [float(i)]) for i in range(30_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_unknown_suffixes_and_hdf5(spark, tmp_path):
    with pytest.raises(ValueError, match="no reader"):
        read_matrix(spark, "a.txt")
    with pytest.raises(ValueError, match="no writer"):
        write_matrix(spark.range(1), [], "a.loom")
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="h5py"):
            read_matrix(spark, str(tmp_path / "a.h5"))
        return
    m = random_matrix(spark, 5, 3)
    write_matrix(m, list("abc"), str(tmp_path / "a.h5"))
    assert read(spark, tmp_path / "a.h5") == (list("abc"), [(r["row_name"], r["values"]) for r in m.orderBy("row_id").collect()])


def test_generators(spark):
    m = random_matrix(spark, 200, 50, seed=5)
    same = random_matrix(spark, 200, 50, seed=5).repartition(7)
    key = lambda f: {r["row_id"]: r["values"] for r in f.collect()}
    assert key(m) == key(same) != key(random_matrix(spark, 200, 50, seed=6))
    x = np.array([*key(m).values()])
    assert x.min() >= 0 and x.max() < 1 and abs(x.mean() - 0.5) < 0.01 and abs(x.std() - 12**-0.5) < 0.01
    y = np.array([*key(random_matrix(spark, 200, 50, low=3, high=2, distribution="normal")).values()])
    assert abs(y.mean() - 3) < 0.1 and abs(y.std() - 2) < 0.1
    ids = spark.range(2000).select(uniform_int(1, F.col("id"), low=2, high=4).alias("x")).distinct()
    assert {r["x"] for r in ids.collect()} == {2, 3, 4}
    z = spark.range(5000).select(normal(1, F.col("id"), mean=1.0, stdev=3.0).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert random_vector(spark, 4).count() == 1 and abs(z[0] - 1) < 0.2 and abs(z[1] - 3) < 0.2


def test_stream(spark, tmp_path):
    rows = [(i % 3, float(i), f"2024-01-01 0{i % 4}:10:00") for i in range(40)]
    frame = spark.createDataFrame(rows, "row_id long, value double, ts string").selectExpr("row_id", "value", "cast(ts as timestamp) ts")
    frame.write.parquet(str(tmp_path / "in"))
    stream = windowed_row_params(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("params").start()
    run.processAllAvailable()
    run.stop()
    order = ["window_start", "row_id"]
    assert spark.table("params").orderBy(order).collect() == windowed_row_params(frame).orderBy(order).collect()


def test_command_line(spark, tmp_path):
    out = str(tmp_path / "net.csv")
    assert cli.main(["-r", "-n", "6", "-v", "9", "-m", "pearson", "-o", out]) == 0
    names, rows = read(spark, out)
    x = np.array([r["values"] for r in random_matrix(spark, 6, 9).orderBy("row_id").collect()])
    assert names == list("012345") and np.allclose([v for _, v in rows], np.corrcoef(x))
    with pytest.raises(SystemExit):
        cli.main(["-r", "-n", "6"])
    with pytest.raises(SystemExit):
        cli.main(["-r", "-i", "x.csv"])


class _File:
    """What the reader and writer use of h5py, over one dict of files."""

    files: dict = {}

    def __init__(self, path, mode):
        self.path = path
        if mode == "w":
            self.files[path] = {}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None

    def __getitem__(self, name):
        return self.files[self.path][name]

    def create_group(self, name):
        class Group(dict):
            attrs: dict = {}

            def create_dataset(self, name, shape=None, data=None, dtype=None):
                self[name] = np.array(data, object) if data is not None else np.zeros(shape, "f8" if dtype == "f8" else object)
                return self[name]

        self.files[self.path][name] = Group()
        return self.files[self.path][name]


def test_hdf5_logic_without_the_library(spark, monkeypatch):
    """The writer's layout, and what each partition of the reader reads, with a stand-in for h5py."""
    monkeypatch.setitem(sys.modules, "h5py", SimpleNamespace(File=_File, string_dtype=lambda _: object))
    monkeypatch.setattr(hdf5, "RANGE", 4)
    m = random_matrix(spark, 10, 3)
    write_matrix(m.repartition(3), list("abc"), "m.h5")
    group = _File.files["m.h5"]["array"]
    assert [*group["axis0"]] == [*group["block0_items"]] == list("abc") and [*group["axis1"]] == [str(i) for i in range(10)]
    want = [r["values"] for r in m.orderBy("row_id").collect()]
    assert group["block0_values"].tolist() == want and group.attrs["pandas_type"] == "frame"
    reader = hdf5._Reader({"path": "m.h5", "group": "array", "row_names": "axis1", "values": "block0_values", "rows": "9", "cols": "2"})
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(0, 4), (4, 8), (8, 9)]
    assert [x for p in parts for x in reader.read(p)] == [(i, str(i), want[i][:2]) for i in range(9)]
