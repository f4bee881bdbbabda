"""The registered queries of the matrix operators and their SQL.

Inputs: E, the `embeddings` as a matrix; C, supplier by month of the summed price of `lineitem`; S, the same with quantities.
Floats are rounded on both sides; adding 0.0 takes the sign from a zero.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import kernels as K
from gridloom.functions import text as T
from gridloom.matrix import bounds, resize, to_long, to_wide, top_left, transpose
from gridloom.operators import distribution as D
from gridloom.operators import pairs as P
from gridloom.operators import patterns as A
from gridloom.operators import ranks as R
from gridloom.operators.correlation import kendall, pearson, pearson_clr, pearson_stouffer, rank_correlation, strongest
from gridloom.plans import tiles as L
from gridloom.sources import read_matrix, write_matrix
from gridloom.sources.random import random_matrix
from gridloom.streaming import windowed_row_params

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MONTHS = 12


def query(sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: str | Column, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(table(spark, sf_dir, "embeddings"))


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").alias("row_id"), F.col("vec_id").cast("string").alias("row_name"), F.col("embedding").cast("array<double>").alias("values"))


def supplier_cells(spark: SparkSession, sf_dir: str, measure: str = "l_extendedprice") -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("row_id"), (F.month("l_shipdate") - 1).cast("long").alias("col_id"), measure)
    return rows.groupBy("row_id", "col_id").agg(F.sum(measure).alias("value"))


def suppliers(spark: SparkSession, sf_dir: str, measure: str = "l_extendedprice") -> DataFrame:
    return to_wide(supplier_cells(spark, sf_dir, measure), MONTHS)


#: SQL of the inputs.
E_SQL = "e AS (SELECT vec_id AS row_id, unnest(range(len(embedding)))::BIGINT AS col_id, unnest(embedding)::DOUBLE AS value FROM embeddings)"
CELLS = "SELECT l_suppkey::BIGINT AS row_id, (month(l_shipdate) - 1)::BIGINT AS col_id, sum({m}) AS value FROM lineitem GROUP BY 1, 2"
FULL = "SELECT row_id, m.c::BIGINT AS col_id, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT l_suppkey::BIGINT AS row_id FROM lineitem) CROSS JOIN range(12) m(c) LEFT JOIN (" + CELLS + ") x ON x.row_id = row_id AND x.col_id = m.c"
FULL = FULL.replace("SELECT row_id, m.c", "SELECT k.row_id, m.c").replace("FROM lineitem) CROSS", "FROM lineitem) k CROSS").replace("x.row_id = row_id", "x.row_id = k.row_id")
C_SQL, S_SQL = "c AS (" + FULL.format(m="l_extendedprice") + ")", "s AS (" + FULL.format(m="l_quantity") + ")"
Z_SQL = "CASE WHEN abs(coalesce(sd, 0)) < 2.220446049250313e-16 THEN 0.0 ELSE (value - mu) / sd END"
PARAMS = "p AS (SELECT *, avg(value) OVER w AS mu, stddev_samp(value) OVER w AS sd FROM {t} WINDOW w AS (PARTITION BY row_id))"
CORR = "r AS (SELECT a.row_id, b.row_id AS col_id, sum(a.z * b.z) / 11 AS value FROM z a JOIN z b ON a.col_id = b.col_id {on} GROUP BY 1, 2)"
C_CORR = f"WITH {C_SQL}, {PARAMS.format(t='c')}, z AS (SELECT row_id, col_id, {Z_SQL} AS z FROM p), {CORR.format(on='')}"


# --- reductions and statistics ---


@query(f"WITH {E_SQL} SELECT row_id, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS stdev FROM e GROUP BY 1")
def row_params_sample(spark, sf_dir):
    out = A.reduce_rows(embeddings(spark, sf_dir), K.mean_stdev, "p")
    return out.select("row_id", rounded("p.mean").alias("mean"), rounded("p.stdev").alias("stdev"))


@query(f"WITH {E_SQL} SELECT row_id, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS stdev FROM e GROUP BY 1")
def row_params_pop(spark, sf_dir):
    out = A.reduce_rows(embeddings(spark, sf_dir), lambda v: K.mean_stdev(v, sample=False), "p")
    return out.select("row_id", rounded("p.mean").alias("mean"), rounded("p.stdev").alias("stdev"))


@query(f"WITH {E_SQL} SELECT row_id, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS stdev FROM e WHERE row_id <> col_id GROUP BY 1")
def row_params_excl1(spark, sf_dir):
    out = A.reduce_rows(embeddings(spark, sf_dir), lambda i, v: K.mean_stdev_without(v, i), "p", positional=True)
    return out.select("row_id", rounded("p.mean").alias("mean"), rounded("p.stdev").alias("stdev"))


@query(f"WITH {E_SQL} SELECT row_id, round(sum(value), 6) + 0.0 AS total FROM e GROUP BY 1")
def row_reduce_sum(spark, sf_dir):
    return A.reduce_rows(embeddings(spark, sf_dir), K.total, "total").select("row_id", rounded("total").alias("total"))


@query(f"WITH {E_SQL} SELECT row_id, round(max(value), 6) + 0.0 AS greatest, round(min(value), 6) + 0.0 AS least FROM e GROUP BY 1")
def row_reduce_bounds(spark, sf_dir):
    out = A.reduce_rows(embeddings(spark, sf_dir), lambda v: F.struct(F.array_max(v).alias("a"), F.array_min(v).alias("b")), "x")
    return out.select("row_id", rounded("x.a").alias("greatest"), rounded("x.b").alias("least"))


@query(f"WITH {E_SQL} SELECT col_id, round(sum(value), 6) + 0.0 AS total, round(avg(value), 6) + 0.0 AS mean FROM e GROUP BY 1")
def col_reduce(spark, sf_dir):
    out = A.reduce_columns(to_long(embeddings(spark, sf_dir)), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return out.select("col_id", rounded("total").alias("total"), rounded("mean").alias("mean"))


@query(f"WITH {E_SQL} SELECT row_id, round(sum(value) FILTER (col_id % 2 = 0), 6) + 0.0 AS total FROM e GROUP BY 1")
def masked_reduce(spark, sf_dir):
    even = lambda v: K.masked_sum(v, F.transform(v, lambda x, i: i % 2 == 0))
    return A.reduce_rows(embeddings(spark, sf_dir), even, "total").select("row_id", rounded("total").alias("total"))


@query(f"WITH {C_SQL} SELECT row_id, round(sum(value), 2) + 0.0 AS total FROM c GROUP BY 1")
def compensated_row_sum(spark, sf_dir):
    return A.reduce_rows(suppliers(spark, sf_dir), K.compensated_sum, "total").select("row_id", rounded("total", 2).alias("total"))


# --- transforms ---


@query(f"WITH {E_SQL}, {PARAMS.format(t='e')} SELECT row_id, col_id, round({Z_SQL}, 6) + 0.0 AS value FROM p")
def zscore_rows(spark, sf_dir):
    return to_long(A.transform(embeddings(spark, sf_dir), K.standard_score)).select("row_id", "col_id", rounded("value").alias("value"))


@query(f"WITH {C_SQL}, {PARAMS.format(t='c')} SELECT row_id, col_id, round({Z_SQL}, 6) + 0.0 AS value FROM p")
def zscore_cells(spark, sf_dir):
    return A.zscore_cells(to_long(suppliers(spark, sf_dir))).select("row_id", "col_id", rounded("value").alias("value"))


@query("SELECT o_orderkey AS row_id, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM orders")
def zscore_constant(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.array_repeat("o_totalprice", 2).alias("values"))
    return A.transform(rows, K.standard_score).select("row_id", F.col("values")[0].alias("a"), F.col("values")[1].alias("b"))


@query(f"""WITH {C_SQL}, d AS (SELECT row_id, col_id, dense_rank() OVER (PARTITION BY row_id ORDER BY value)::DOUBLE AS value FROM c),
    {PARAMS.format(t='d')} SELECT row_id, col_id, round({Z_SQL}, 6) + 0.0 AS value FROM p""")
def composite_rank_zscore(spark, sf_dir):
    return to_long(A.transform(R.rank_values(suppliers(spark, sf_dir)), K.standard_score)).select("row_id", "col_id", rounded("value").alias("value"))


@query(f"WITH {C_SQL}, {S_SQL} SELECT row_id, col_id, round(c.value + s.value, 2) + 0.0 AS value FROM c JOIN s USING (row_id, col_id)")
def binary_add(spark, sf_dir):
    out = A.binary_op(suppliers(spark, sf_dir), suppliers(spark, sf_dir, "l_quantity"), lambda x, y: x + y)
    return to_long(out).select("row_id", "col_id", rounded("value", 2).alias("value"))


@query(f"WITH {C_SQL}, {S_SQL} SELECT row_id, col_id, round(c.value / 1000 * s.value, 2) + 0.0 AS value FROM c JOIN s USING (row_id, col_id)")
def binary_mul(spark, sf_dir):
    out = A.binary_op(suppliers(spark, sf_dir), suppliers(spark, sf_dir, "l_quantity"), lambda x, y: x / 1000 * y)
    return to_long(out).select("row_id", "col_id", rounded("value", 2).alias("value"))


@query(f"WITH {C_SQL} SELECT col_id AS row_id, row_id AS col_id, round(value, 2) + 0.0 AS value FROM c")
def transpose_cells(spark, sf_dir):
    return transpose(to_long(suppliers(spark, sf_dir))).select("row_id", "col_id", rounded("value", 2).alias("value"))


@query(f"WITH {C_SQL} SELECT row_id, col_id, round(value, 2) + 0.0 AS value FROM c WHERE row_id < 7 AND col_id < 5")
def slice_top_left(spark, sf_dir):
    return to_long(top_left(suppliers(spark, sf_dir), 7, 5)).select("row_id", "col_id", rounded("value", 2).alias("value"))


@query(f"""WITH {C_SQL} SELECT r.r::BIGINT AS row_id, k.c::BIGINT AS col_id, round(coalesce(value, 0.0), 2) + 0.0 AS value
    FROM range(130) r(r) CROSS JOIN range(14) k(c) LEFT JOIN c ON c.row_id = r.r AND c.col_id = k.c""")
def resize_zero_fill(spark, sf_dir):
    return to_long(resize(suppliers(spark, sf_dir), 130, 14)).select("row_id", "col_id", rounded("value", 2).alias("value"))


# --- ranks ---

LINES = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("row_id"), "l_quantity", *LINES)


@query("SELECT l_suppkey AS row_id, l_quantity, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity)::INT AS rank FROM lineitem")
def dense_rank_rows(spark, sf_dir):
    return R.rank_cells(_lines(spark, sf_dir), LINES, value="l_quantity").select("row_id", "l_quantity", "rank")


@query(f"""SELECT l_suppkey AS row_id, l_orderkey, l_quantity, (dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1)::INT AS rank,
    (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, {', '.join(LINES)}) - 1)::INT AS pos FROM lineitem""")
def rank_pos_rows(spark, sf_dir):
    return R.rank_cells(_lines(spark, sf_dir), LINES, value="l_quantity", first=0).select("row_id", "l_orderkey", "l_quantity", "rank", "pos")


@query(f"""SELECT l_suppkey AS row_id, l_orderkey, l_quantity, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC)::INT AS rank,
    (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, {', '.join(LINES)}) - 1)::INT AS pos FROM lineitem""")
def rank_desc(spark, sf_dir):
    return R.rank_cells(_lines(spark, sf_dir), LINES, value="l_quantity", ascending=False).select("row_id", "l_orderkey", "l_quantity", "rank", "pos")


@query(f"""WITH {E_SQL} SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY value, col_id) - 1)::BIGINT AS pos, col_id, round(value, 6) + 0.0 AS value FROM e""")
def sort_rows(spark, sf_dir):
    out = embeddings(spark, sf_dir).select("row_id", F.posexplode(R.sorted_values(F.col("values"))).alias("pos", "x"))
    return out.select("row_id", F.col("pos").cast("long").alias("pos"), F.col("x.index").cast("long").alias("col_id"), rounded("x.value").alias("value"))


EVENTS = "SELECT user_id, ts, event_id, round(value, 0) AS k, value AS w FROM events"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.round("value", 0).alias("k"), F.col("value").alias("w"))


def _earlier(sign: str) -> str:
    return f"""WITH v AS ({EVENTS}) SELECT a.user_id, a.event_id, round(coalesce(sum(b.w), 0.0), 4) + 0.0 AS total FROM v a
        LEFT JOIN v b ON a.user_id = b.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id) AND b.k {sign} a.k GROUP BY 1, 2"""


@query(_earlier("<"))
def concordant_sum(spark, sf_dir):
    out = R.earlier_sums(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "k", "w")
    return out.select("user_id", "event_id", rounded("total", 4).alias("total"))


@query(_earlier(">"))
def discordant_sum(spark, sf_dir):
    out = R.earlier_sums(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "k", "w", concordant=False)
    return out.select("user_id", "event_id", rounded("total", 4).alias("total"))


@query(f"""WITH v AS ({EVENTS}) SELECT a.user_id, count(b.event_id) AS n_inversions FROM v a
    LEFT JOIN v b ON a.user_id = b.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id) AND b.k > a.k GROUP BY 1""")
def inversion_count(spark, sf_dir):
    return R.inversions(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "k")


# --- all pairs ---

PAIRS = "SELECT a.row_id, b.row_id AS col_id, round({x}, 6) + 0.0 AS value FROM e a JOIN e b ON a.col_id = b.col_id AND a.row_id <= b.row_id GROUP BY 1, 2"


@query(f"WITH {E_SQL} " + PAIRS.format(x="sum(a.value * b.value)"))
def dot_all_pairs(spark, sf_dir):
    return P.all_pairs(embeddings(spark, sf_dir), places=6)


@query(f"WITH {E_SQL} " + PAIRS.format(x="sum(a.value * b.value) + a.row_id - b.row_id"))
def inner_product_pos(spark, sf_dir):
    return P.all_pairs(embeddings(spark, sf_dir), kernel=lambda i, j, a, b: a @ b.T - abs(i[:, None] - j[None, :]), places=6)


@query(f"WITH {E_SQL} " + PAIRS.format(x="sum(abs(a.value - b.value))"))
def pairs_by_expression(spark, sf_dir):
    return P.all_pairs(embeddings(spark, sf_dir), kernel=P.folded(lambda x, y: abs(x - y)), places=6)


@query(f"""WITH {E_SQL}, g AS (SELECT vec_id, label FROM embeddings) SELECT a.row_id, b.row_id AS col_id, round(sum(a.value * b.value), 6) + 0.0 AS value
    FROM e a JOIN g ga ON ga.vec_id = a.row_id AND ga.label < 3 JOIN e b ON a.col_id = b.col_id JOIN g gb ON gb.vec_id = b.row_id AND gb.label >= 3 GROUP BY 1, 2""")
def dot_two_matrices(spark, sf_dir):
    of = lambda condition: _vectors(table(spark, sf_dir, "embeddings").filter(condition))
    return P.all_pairs(of("label < 3"), of("label >= 3"), places=6)


@query(f"WITH {E_SQL}, {PARAMS.format(t='e')}, z AS (SELECT row_id, col_id, {Z_SQL} AS value FROM p) " + PAIRS.replace("FROM e a JOIN e b", "FROM z a JOIN z b").format(x="sum(a.value * b.value) / 63"))
def pearson_all_pairs(spark, sf_dir):
    return pearson(embeddings(spark, sf_dir), 64, places=6)


@query(f"""WITH {C_SQL}, d AS (SELECT row_id, col_id, dense_rank() OVER (PARTITION BY row_id ORDER BY value)::DOUBLE AS value FROM c), {PARAMS.format(t='d')},
    z AS (SELECT row_id, col_id, {Z_SQL} AS z FROM p), {CORR.format(on='AND a.row_id <= b.row_id')} SELECT row_id, col_id, round(value, 6) + 0.0 AS value FROM r""")
def rank_corr_all_pairs(spark, sf_dir):
    return rank_correlation(suppliers(spark, sf_dir), MONTHS, places=6)


@query(f"""WITH {C_SQL}, q AS (SELECT a.row_id AS i, a.col_id AS x, b.col_id AS y, sign(a.value - b.value) AS s FROM c a JOIN c b ON a.row_id = b.row_id AND a.col_id < b.col_id)
    SELECT a.i AS row_id, b.i AS col_id, round(sum(a.s * b.s) / 66.0, 6) + 0.0 AS value FROM q a JOIN q b ON a.x = b.x AND a.y = b.y AND a.i <= b.i GROUP BY 1, 2""")
def kendall_all_pairs(spark, sf_dir):
    return kendall(suppliers(spark, sf_dir), places=6)


# --- networks ---


@query(C_CORR + " SELECT row_id, col_id, round(value, 6) + 0.0 AS value FROM r")
def adjacency(spark, sf_dir):
    return pearson(suppliers(spark, sf_dir), MONTHS, both=True, places=6)


BACKGROUND = ", k AS (SELECT row_id, avg(value) AS mu, stddev_samp(value) AS sd FROM r WHERE row_id <> col_id GROUP BY 1), x AS (SELECT r.row_id, r.col_id, (r.value - a.mu) / a.sd AS zr, (r.value - b.mu) / b.sd AS zc FROM r JOIN k a ON a.row_id = r.row_id JOIN k b ON b.row_id = r.col_id)"


@query(C_CORR + BACKGROUND + " SELECT row_id, col_id, round(sqrt(greatest(zr, 0) ** 2 + greatest(zc, 0) ** 2), 5) + 0.0 AS value FROM x")
def reduce_transform_clr(spark, sf_dir):
    return pearson_clr(suppliers(spark, sf_dir), MONTHS, places=5)


@query(C_CORR + BACKGROUND + " SELECT row_id, col_id, round((zr + zc) / sqrt(2.0), 5) + 0.0 AS value FROM x")
def reduce_transform_stouffer(spark, sf_dir):
    return pearson_stouffer(suppliers(spark, sf_dir), MONTHS, places=5)


@query(C_CORR + " SELECT row_id, col_id, round(value, 6) + 0.0 AS value, (row_number() OVER (PARTITION BY row_id ORDER BY value DESC, col_id))::INT AS place FROM r WHERE row_id <> col_id QUALIFY place <= 5")
def topk_edges(spark, sf_dir):
    return strongest(suppliers(spark, sf_dir), MONTHS, 5).select("row_id", "col_id", rounded("value").alias("value"), "place")


@query(C_CORR + " SELECT row_id, col_id, round(value, 6) + 0.0 AS value FROM r WHERE row_id <= col_id AND abs(value) >= 0.7")
def threshold_edges(spark, sf_dir):
    return pearson(suppliers(spark, sf_dir), MONTHS, at_least=0.7, places=6)


# --- partitions and tiles ---

GRID = "g AS (SELECT r.r::BIGINT * 5 + c.c::BIGINT AS tile_id, r.r::BIGINT AS r, c.c::BIGINT AS c, r.r::BIGINT * 20 AS row_off, least(20, 90 - r.r * 20)::BIGINT AS n_rows, c.c::BIGINT * 20 AS col_off, least(20, 90 - c.c * 20)::BIGINT AS n_cols FROM range(5) r(r) CROSS JOIN range(5) c(c))"
COLUMNS = "tile_id, r, c, row_off, n_rows, col_off, n_cols"


def _grid(spark):
    return L.fixed_grid(spark, 90, 90, 20, 20)


@query("SELECT i AS id, i * 14 + least(i, 2) AS off, 14 + (i < 2)::INT AS n FROM (SELECT range::BIGINT AS i FROM range(7))".replace("14 + (i < 2)::INT AS n", "(14 + (i < 2)::INT)::BIGINT AS n").replace("i * 14 + least(i, 2) AS off", "(i * 14 + least(i, 2))::BIGINT AS off"))
def partition_equal(spark, sf_dir):
    return L.equal_parts(spark, 100, 7)


@query("SELECT i AS id, (i * 16)::BIGINT AS off, least(16, 100 - i * 16)::BIGINT AS n FROM (SELECT range::BIGINT AS i FROM range(7))")
def partition_fixed(spark, sf_dir):
    return L.fixed_parts(spark, 100, 16)


@query("WITH p AS (SELECT l_suppkey % 7 AS part, count(*) AS n FROM lineitem GROUP BY 1) SELECT part, n, (sum(n) OVER (ORDER BY part) - n)::BIGINT AS off FROM p")
def partition_offsets(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return D.offsets(sizes)


@query(f"WITH {E_SQL}, r AS (SELECT DISTINCT row_id FROM e) SELECT row_id, CASE WHEN row_id < (m.n % 7) * (m.n // 7 + 1) THEN row_id // (m.n // 7 + 1) ELSE m.n % 7 + (row_id - (m.n % 7) * (m.n // 7 + 1)) // (m.n // 7) END AS part FROM r, (SELECT count(*) AS n FROM embeddings) m")
def row_partition(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return D.part_of_rows(rows, rows.count(), 7).select("row_id", "part")


@query(f"WITH {GRID} SELECT * FROM g")
def tile_grid(spark, sf_dir):
    return _grid(spark)


@query("""WITH p AS (SELECT range::BIGINT AS i, (range * 3 + least(range, 1))::BIGINT AS off, (3 + (range < 1)::INT)::BIGINT AS n FROM range(3)), q AS (SELECT range::BIGINT AS i, (range * 5 + least(range, 2))::BIGINT AS off, (5 + (range < 2)::INT)::BIGINT AS n FROM range(4))
    SELECT p.i * 4 + q.i AS tile_id, p.i AS r, q.i AS c, p.off AS row_off, p.n AS n_rows, q.off AS col_off, q.n AS n_cols FROM p CROSS JOIN q""")
def tile_grid_equal(spark, sf_dir):
    return L.equal_grid(spark, 10, 22, 3, 4)


@query(f"WITH {GRID} SELECT row_number() OVER (ORDER BY r, c) - 1 AS tile_id, r, c, row_off, n_rows, col_off, n_cols FROM g WHERE c - 1 >= r")
def upper_triangle(spark, sf_dir):
    return L.upper_triangle(_grid(spark), 1).select(*COLUMNS.split(", "))


@query(f"WITH {GRID} SELECT * FROM g WHERE ((c - r + 5) % 5) * 5 + r < 15")
def banded_filter(spark, sf_dir):
    return L.banded(_grid(spark), 5)


@query(f"WITH {GRID} SELECT min(row_off) AS row_off, max(row_off + n_rows) - min(row_off) AS n_rows, min(col_off) AS col_off, max(col_off + n_cols) - min(col_off) AS n_cols FROM g WHERE c > r")
def tile_bounds(spark, sf_dir):
    return L.tile_bounds(L.upper_triangle(_grid(spark), 1))


@query(f"WITH {GRID} SELECT {COLUMNS} FROM g WHERE c >= r UNION ALL SELECT tile_id, c, r, col_off, n_cols, row_off, n_rows FROM g WHERE c > r")
def tile_reflect(spark, sf_dir):
    return L.reflected_diagonally(_grid(spark).filter("c >= r"))


@query(f"WITH {GRID} SELECT tile_id, c AS r, r AS c, col_off AS row_off, n_cols AS n_rows, row_off AS col_off, n_rows AS n_cols FROM g")
def tile_transpose(spark, sf_dir):
    return L.transposed(_grid(spark))


@query(f"WITH {GRID} SELECT * FROM g WHERE r = 0 UNION ALL SELECT * FROM g WHERE c = 0")
def tile_merge(spark, sf_dir):
    return L.merged(_grid(spark).filter("r = 0"), _grid(spark).filter("c = 0"))


@query(f"WITH {C_SQL} SELECT row_id, col_id, round(value, 2) + 0.0 AS value FROM c WHERE value <> 0")
def tile_round_trip(spark, sf_dir):
    cells = L.cells_of(L.tiles_of(supplier_cells(spark, sf_dir), 16, 5))
    return cells.filter("value <> 0").select("row_id", "col_id", rounded("value", 2).alias("value"))


@query(f"WITH {C_SQL} SELECT col_id AS row_id, row_id AS col_id, round(value, 2) + 0.0 AS value FROM c WHERE value <> 0")
def tile_transpose_cells(spark, sf_dir):
    cells = L.cells_of(L.transposed(L.tiles_of(supplier_cells(spark, sf_dir), 16, 5)))
    return cells.filter("value <> 0").select("row_id", "col_id", rounded("value", 2).alias("value"))


@query(f"WITH {E_SQL}, g AS (SELECT a.row_id, b.row_id AS col_id, sum(a.value * b.value) AS value FROM e a JOIN e b ON a.col_id = b.col_id WHERE a.row_id < 70 AND b.row_id < 70 GROUP BY 1, 2) SELECT row_id, col_id, round(value, 6) + 0.0 AS value FROM g")
def tile_reflect_cells(spark, sf_dir):
    """The product of 70 rows with themselves, from the tiles on and above the diagonal."""
    upper = P.reflected(P.all_pairs(embeddings(spark, sf_dir).filter("row_id < 70"))).filter("floor(row_id / 10) <= floor(col_id / 10)")
    return L.cells_of(L.reflected_diagonally(L.tiles_of(upper, 10, 10))).select("row_id", "col_id", rounded("value").alias("value"))


@query(f"WITH {C_SQL} SELECT min(row_id) AS row_off, max(row_id) - min(row_id) + 1 AS n_rows, min(col_id) AS col_off, max(col_id) - min(col_id) + 1 AS n_cols FROM c WHERE value <> 0")
def cell_bounds(spark, sf_dir):
    return bounds(supplier_cells(spark, sf_dir))


# --- text ---


@query("SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> ''))::INT AS n, (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END)::INT AS n_with_empty FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.count_tokens(F.col("text"), " ").alias("n"), T.count_tokens(F.col("text"), " ", empty=True).alias("n_with_empty"))


@query("SELECT event_id, unnest(range(len(string_split(props, ','))))::INT AS k, unnest(string_split(props, ',')) AS token FROM events WHERE props <> ''")
def token_or_empty(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(T.tokens_or_empty(F.col("props"))).alias("k", "token"))


@query(r"""WITH t AS (SELECT event_id, regexp_replace(props, '^[^0-9+.-]*', '') AS x FROM events)
    SELECT event_id, coalesce(try_cast(regexp_extract(x, '^[+-]?[0-9]*\.?[0-9]*') AS DOUBLE), 0.0) AS number FROM t""")
def numeric_prefix(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.numeric_prefix(F.regexp_replace("props", "^[^0-9+.-]*", "")).alias("number"))


def _scratch(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gridloom-")
    return f"{root.rstrip('/')}/matrix-{uuid.uuid4().hex}"


def _round_trip(spark, sf_dir, suffix, skip):
    path = _scratch(spark) + suffix
    write_matrix(suppliers(spark, sf_dir), [f"m{i}" for i in range(MONTHS)], path, skip=skip)
    m = read_matrix(spark, path, skip=skip)
    return to_long(m.rows.select(F.col("row_name").cast("long").alias("row_id"), "values")).select("row_id", "col_id", rounded("value", 2).alias("value"))


@query(f"WITH {C_SQL} SELECT row_id, col_id, round(value, 2) + 0.0 AS value FROM c")
def csv_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, ".csv", False)


@query(f"WITH {C_SQL} SELECT row_id, col_id, round(value, 2) + 0.0 AS value FROM c")
def exp_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, ".exp", True)


@query("SELECT 12000 AS n, true AS inside, true AS same, true AS centred, true AS spread")
def random_matrix_uniform(spark, sf_dir):
    """What must hold of the values of 300 x 40 cells: their number, bounds, mean, and that another partitioning gives the same."""
    cells, again = to_long(random_matrix(spark, 300, 40)), to_long(random_matrix(spark, 300, 40).repartition(5)).withColumnRenamed("value", "again")
    inside = F.min((F.col("value") >= 0) & (F.col("value") < 1))
    return cells.join(again, ["row_id", "col_id"]).agg(F.count(F.lit(1)).alias("n"), inside.alias("inside"), F.min(F.col("value") == F.col("again")).alias("same"), (F.abs(F.avg("value") - 0.5) < 0.01).alias("centred"), (F.count_distinct("value") > 11_000).alias("spread"))


@query("SELECT date_trunc('hour', ts) AS window_start, user_id AS row_id, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(coalesce(stddev_samp(value), 0.0), 6) + 0.0 AS stdev FROM events GROUP BY 1, 2")
def windowed_params(spark, sf_dir):
    out = windowed_row_params(table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("row_id"), "value"))
    return out.select("window_start", "row_id", "n", rounded("mean").alias("mean"), rounded("stdev").alias("stdev"))
