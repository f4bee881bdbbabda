"""Delimited matrices: CSV (name, values) and EXP (id, alias, values; tab).

Lines are read as text and split: quotes aren't interpreted and names may repeat. Rules: blank lines are skipped, CR is
dropped, an empty or unreadable field is 0, a short row is filled with 0, a long one cut; a header with fewer
names than asked for is an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.text import LARGEST, numeric_prefix, strict_number

#: Fixed values of the formats: delimiter and label columns by suffix.
FORMATS = {".csv": (",", 1), ".exp": ("\t", 2)}
ALIAS, SKIPPED_LINE = "---", "empty"
#: Blocks of a file, a small row each, that are broadcast.
MOST_BLOCKS = 50_000


@dataclass
class Matrix:
    """rows: row_id, row_name, values; columns: their names, in order."""

    rows: DataFrame
    columns: list[str]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, lines that aren't blank) and value, in the order of files and of lines. No line is shuffled.

    Lines are counted for each block of a file; the running sum over blocks, a row each, goes to the lines by a join on
    the block. It is broadcast while the blocks are at most MOST_BLOCKS; beyond, Spark decides.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    blocks = blocks.select("file", "block", "first", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("before"))
    scan = spark.read.text(path)
    few = scan.rdd.getNumPartitions() + len(scan.inputFiles()) <= MOST_BLOCKS
    met = lines.join(F.broadcast(blocks) if few else blocks, ["file", "block"], "left")
    known = F.coalesce("before", F.raise_error(F.lit("the file's blocks changed while it was read")).cast("long"))
    return met.select((known + F.col("at") - F.col("first")).alias("line_no"), "value")


def _head(spark: SparkSession, path: str, after: bool) -> list[str]:
    """The first lines, to the header and, if asked for, the two lines that follow it and its blank lines."""
    files = sorted(spark.read.text(path).inputFiles())
    head: list[str] = []
    for file in [path] if len(files) == 1 else map(unquote, files):
        size = 64
        while True:
            some = [r["value"] for r in spark.read.text(file).limit(size).collect()]
            filled = [i for i, line in enumerate(head + some) if line.strip(" ")]
            if len(filled) > after and (not after or filled[1] + 1 < len(head + some)):
                return head + some
            if len(some) < size:
                break
            size *= 8
        head += some
    return head


def read_text_matrix(spark: SparkSession, path: str, rows: int = 0, cols: int = 0, skip: bool = False, strict: bool = False) -> Matrix:
    """skip: leave out the two lines after the header and the blank lines that follow it (EXP). strict: unreadable numbers are null, not 0."""
    delimiter, labels = FORMATS[path[-4:]]
    skip = skip and delimiter == "\t"
    head = _head(spark, path, skip)
    filled = [i for i, line in enumerate(head) if line.strip(" ")]
    if not filled:
        raise ValueError(f"{path} is empty")
    names = head[filled[0]].split(delimiter)[labels:]
    if cols > len(names):
        raise ValueError(f"{path} names {len(names)} columns, not {cols}")
    names = names[: cols or len(names)]
    first = 1
    if skip and len(filled) > 1:  # the second line left out may be blank, and isn't numbered then
        first += 1 + (filled[1] + 1 in filled)
    body = numbered_lines(spark, path).filter(F.col("line_no") >= first)
    body = body.filter(F.col("line_no") < first + rows) if rows else body
    fields = body.select((F.col("line_no") - first).alias("row_id"), F.split("value", delimiter, -1).alias("fields"))
    if not names:
        return Matrix(fields.select("row_id", F.col("fields")[0].alias("row_name"), F.array().cast("array<double>").alias("values")), names)
    texts = F.slice("fields", labels + 1, len(names))
    number = strict_number if strict else lambda c: numeric_prefix(F.coalesce(c, F.lit("")))
    slow = F.transform(F.sequence(F.lit(labels), F.lit(labels + len(names) - 1)), lambda i: number(F.get("fields", i)))
    # A row of finite decimal numbers is cast as a whole; others go field by field.
    cast = fields.select("row_id", F.col("fields")[0].alias("row_name"), "fields", texts.try_cast("array<double>").alias("cast"))
    plain = (F.size("cast") == len(names)) & ~F.exists("cast", lambda x: x.isNull() | ~(F.abs(x) <= LARGEST)) & ~F.array_join(texts, " ").rlike("[xX]")
    return Matrix(cast.select("row_id", "row_name", F.when(plain, F.col("cast")).otherwise(slow).alias("values")), names)


def write_text_matrix(wide: DataFrame, columns: list[str], path: str, skip: bool = False, single_file: bool = False) -> None:
    """Part files in row order, the header at the front of the first; single_file: one part."""
    delimiter, labels = FORMATS[path[-4:]]
    spark = wide.sparkSession
    head = [delimiter.join(["", *columns] if labels == 1 else ["Id", "Alias", *columns])]
    head += [SKIPPED_LINE] * 2 if skip and labels == 2 else []
    lead = [F.col("row_name")] + [F.lit(ALIAS)] * (labels - 1)
    body = wide.select("row_id", F.concat_ws(delimiter, *lead, F.transform("values", lambda x: x.cast("string"))).alias("line"))
    lines = spark.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "row_id long, line string").unionByName(body)
    ordered = lines.coalesce(1).sortWithinPartitions("row_id") if single_file else lines.repartitionByRange("row_id").sortWithinPartitions("row_id")
    ordered.select("line").write.mode("overwrite").text(path)
