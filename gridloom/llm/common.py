"""What the text operators share: reading tables, written intermediate tables, let-bindings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java and Python pattern.
SPACES = r"[\x20\x09-\x0D]+"
#: Values that running() merges at a time.
RUN = 256

_written: list[tuple[SparkSession, str]] = []
_own_root: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process may go without; it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own_root:
            _own_root["dir"] = tempfile.mkdtemp(prefix="gridloom-")
            atexit.register(shutil.rmtree, _own_root["dir"], ignore_errors=True)
        root = _own_root["dir"]
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df under the shared folder and reads it back: later plans start from the files, which outlive executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/gridloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Removes a table that materialize() wrote and that nothing reads any more."""
    paths = {p.rsplit("/", 1)[0] for p in df.inputFiles()}
    for item in [x for x in _written if any(p.endswith(x[1].removeprefix("file:")) for p in paths)]:
        _remove(*item)
        _written.remove(item)


def spread(rows: DataFrame) -> DataFrame:
    """rows for a join that shuffles both sides. Spark takes exploded rows for as large as the rows before, and stored rows for as large as their
    files, however well those are compressed; it would broadcast a table many times its limit, through the driver's memory."""
    return rows.hint("merge")


def drop_shuffles(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of jobs that are done: it does so once the JVM has collected what refers to them."""
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean_up() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM has ended
            return


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names made from names that docs doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def rewritten(rows: DataFrame, docs: DataFrame, where: Column, text: Column) -> DataFrame:
    """The columns of docs from rows, with another text and, if there is n_chars, its length where the condition holds."""
    out = rows.withColumn("text", F.when(where, text).otherwise(F.col("text")))
    for column in [c for c in docs.columns if c.lower() == "n_chars"]:
        kind = docs.schema[column].dataType
        out = out.withColumn(column, F.when(where, F.length("text").cast(kind)).otherwise(named(column)))
    return out.select(*map(named, docs.columns))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda variable is not inlined, unlike a projected column."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(value: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running(values: Column, zero: Column, merge, body) -> Column:
    """body(before), where before(i) merges the values before i. Runs of RUN values are merged ahead, so many values cost a run each."""

    def over(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / RUN).cast("int")), lambda r: F.aggregate(F.slice(v, F.lit(1), r * RUN), zero, merge))

        def with_runs(ahead: Column) -> Column:
            def before(i: Column) -> Column:
                run = F.floor(i / RUN).cast("int")
                return F.aggregate(F.slice(v, run * RUN + 1, i % RUN), ahead[run], merge)

            return body(before)

        return let(runs, with_runs)

    return let(values, over)
