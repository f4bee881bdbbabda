"""Patterns, ranks, pairs and tiles against NumPy and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import matrix as M
from gridloom.operators import pairs as P
from gridloom.operators import patterns as A
from gridloom.operators import ranks as R
from gridloom.operators.correlation import kendall, pearson, pearson_clr, pearson_stouffer, rank_correlation, strongest
from gridloom.plans import tiles as L


def wide(spark, array):
    return spark.createDataFrame([(i, f"n{i}", [float(x) for x in v]) for i, v in enumerate(array)], "row_id long, row_name string, values array<double>")


def dense(frame, shape):
    out = np.zeros(shape)
    for r in frame.collect():
        out[r["row_id"], r["col_id"]] = r["value"]
    return out


def test_round_trips_and_shapes(spark):
    a = np.arange(12.0).reshape(3, 4)
    m = wide(spark, a)
    assert (dense(M.to_long(m), (3, 4)) == a).all() and (dense(M.transpose(M.to_long(m)), (4, 3)) == a.T).all()
    back = M.to_wide(M.to_long(m).filter("value % 5 <> 0"), 4, m.select("row_id", "row_name")).orderBy("row_id").collect()
    assert [r["values"] for r in back] == np.where(a % 5 == 0, 0, a).tolist() and back[1]["row_name"] == "n1"
    assert dense(M.to_long(M.resize(m, 2, 6)), (2, 6)).tolist() == np.pad(a[:2], ((0, 0), (0, 2))).tolist()
    assert M.top_left(m, 2, 0).count() == 2 and M.top_left(m, 9, 9).count() == 3
    assert M.cell(m, 1, 2).first()[0] == 6.0 and M.zeros_like(m).first()["values"] == [0.0] * 4
    with pytest.raises(Exception, match="has 4 values, not 5"):
        M.checked(m, 5).collect()


def test_ranks(spark):
    values = [2, 1, 2, 3, 3, 1, -0.0, 0.0, float("nan"), float("nan")]
    cells = spark.createDataFrame([(0, i, v) for i, v in enumerate(map(float, values))], "row_id long, col_id long, value double")
    got = R.rank_cells(cells, ["col_id"]).orderBy("col_id").collect()
    assert [r["rank"] for r in got] == [3, 2, 3, 4, 4, 2, 1, 1, 5, 5] == [int(x) for x in R.rank_values(wide(spark, [values])).first()["values"]]
    assert [r["pos"] for r in got] == [4, 2, 5, 6, 7, 3, 0, 1, 8, 9]
    down = R.rank_cells(cells.filter("not isnan(value)"), ["col_id"], first=0, ascending=False).orderBy("col_id").collect()
    assert [r["rank"] for r in down] == [1, 2, 1, 0, 0, 2, 3, 3]
    pairs = wide(spark, [[2, 1, 2]]).select(R.sorted_values(F.col("values"), ascending=False).alias("s")).first()["s"]
    assert [(p["value"], p["index"]) for p in pairs] == [(2.0, 0), (2.0, 2), (1.0, 1)]


def test_earlier_sums(spark):
    rng = random.Random(1)
    rows = [(g, i, float(rng.randrange(6)), float(rng.randrange(1, 9))) for g in range(5) for i in range(rng.randrange(1, 40))]
    cells = spark.createDataFrame(rows, "g long, i long, k double, w double")
    for concordant in (True, False):
        got = {(r["g"], r["i"]): r["total"] for r in R.earlier_sums(cells, ["g"], ["i"], "k", "w", concordant).collect()}
        assert got == {(g, i): sum(w for h, j, q, w in rows if h == g and j < i and (q < k if concordant else q > k)) for g, i, k, _ in rows}
    first = R.inversions(spark.createDataFrame([(0, i, float(k)) for i, k in enumerate([1, 3, 2, 2, 4])], "g long, i long, k double"), ["g"], ["i"], "k").first()
    assert first["n_inversions"] == 2


@pytest.mark.parametrize("tile", [1, 3, 7, 256])
def test_all_pairs(spark, tile):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(7, 4)), rng.normal(size=(5, 4))
    assert np.allclose(dense(P.reflected(P.all_pairs(wide(spark, a), tile=tile)), (7, 7)), a @ a.T)
    assert np.allclose(dense(P.all_pairs(wide(spark, a[:3]), wide(spark, b), tile=tile), (3, 5)), a[:3] @ b.T)
    far = P.all_pairs_by_expression(wide(spark, a), lambda i, j, x, y: i * 10.0 + j, tile=tile)
    assert dense(far, (7, 7)).tolist() == [[10.0 * i + j if i <= j else 0.0 for j in range(7)] for i in range(7)]


def test_sums_over_elements_run_in_tiles(spark):
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(size=(23, 6)), 1)
    a[17] = a[4]
    want = np.triu(np.abs(a[:, None] - a[None]).sum(-1))
    got = P.all_pairs(wide(spark, a), kernel=P.folded(lambda x, y: abs(x - y)), tile=4, places=1)
    assert dense(got, (23, 23)).tolist() == np.round(want, 1).tolist() and got.count() == 23 * 24 // 2
    assert P.half_up(np.array([0.5, -0.5, 2.5, -0.2, 1.45]), 0).tolist() == [1.0, -1.0, 3.0, 0.0, 1.0]


def test_correlations(spark):
    rng = np.random.default_rng(3)
    a = np.round(rng.normal(size=(6, 9)), 1)
    a[4] = 2.5
    got = dense(P.reflected(pearson(wide(spark, a), 9)), (6, 6))
    with np.errstate(invalid="ignore"):
        want = np.nan_to_num(np.corrcoef(a))
    assert np.allclose(got, want) and not got[4].any()
    assert np.allclose(dense(pearson(wide(spark, a), 9, at_least=0.3), (6, 6)), np.triu(np.where(np.abs(want) >= 0.3, want, 0)))
    ranks = np.array([np.unique(v, return_inverse=True)[1] for v in a], float)
    with np.errstate(invalid="ignore"):
        assert np.allclose(dense(P.reflected(rank_correlation(wide(spark, a), 9)), (6, 6)), np.nan_to_num(np.corrcoef(ranks)))
    s = np.sign(a[:, :, None] - a[:, None, :]).reshape(6, -1)
    assert np.allclose(dense(P.reflected(kendall(wide(spark, a))), (6, 6)), s @ s.T / 72)


def test_reduce_transform_on_a_flat_background(spark):
    flat = M.to_long(wide(spark, np.ones((4, 4))))
    assert not dense(A.clr(flat), (4, 4)).any() and not dense(A.stouffer(flat), (4, 4)).any()
    top = P.top_edges(M.to_long(wide(spark, [[0, 5, 5], [1, 0, 2], [3, 3, 0]])), 1)
    assert {(r["row_id"], r["col_id"]) for r in top.collect()} == {(0, 1), (1, 2), (2, 0)}


def _plan(frame):
    return frame._jdf.queryExecution().toString()


@pytest.mark.parametrize("build", [lambda m: pearson(m, 5, at_least=0.7), lambda m: pearson(m, 5, both=True), lambda m: rank_correlation(m, 5), kendall, lambda m: strongest(m, 5, 2)])
def test_tiles_are_never_broadcast(spark, build):
    m = wide(spark, np.random.default_rng(6).normal(size=(9, 5)))
    assert "Broadcast" not in _plan(build(m)) and "Join" not in _plan(build(m))


def test_few_copies_of_a_row_travel(spark):
    """Rows travel once for each block they meet, of which there are few, not for each tile of 256 rows."""
    assert P.block_rows(51_282, 64, 256) == 1536 and P.block_rows(10**6, 64, 256) == 8192 and P.block_rows(500, 64, 256) == 256
    assert P.block_rows(10**6, 1024, 256) == 512 and P.block_rows(10, 10**9, 256) == 256
    a = np.random.default_rng(7).normal(size=(700, 2))
    size = P.shape(wide(spark, a))
    assert size == (700, 2) and P._tiles(wide(spark, a), None, 2, size, size).count() <= 34 * 35 // 2


@pytest.mark.parametrize("tile", [1, 3, 256])
def test_networks_inside_tiles(spark, tile):
    """Cells scored, and the strongest edges chosen, inside the tiles: as the operators on the whole network give them."""
    a = np.round(np.random.default_rng(8).normal(size=(11, 7)), 1)
    a[9], a[5], a[10] = a[2], a[2], 1.5
    m = wide(spark, a)
    network = P.reflected(pearson(m, 7)).cache()
    assert np.allclose(dense(pearson(m, 7, tile=tile, both=True), (11, 11)), dense(network, (11, 11)))
    assert np.allclose(dense(pearson_clr(m, 7, tile), (11, 11)), dense(A.clr(network), (11, 11)))
    assert np.allclose(dense(pearson_stouffer(m, 7, tile), (11, 11)), dense(A.stouffer(network), (11, 11)))
    got = sorted((r["row_id"], r["place"], r["col_id"]) for r in strongest(m, 7, 4, tile).collect())
    with np.errstate(invalid="ignore"):
        exact = np.round(np.nan_to_num(np.corrcoef(a)), 9)
    assert got == [(i, n + 1, j) for i in range(11) for n, j in enumerate(sorted(set(range(11)) - {i}, key=lambda j: (-exact[i, j], j))[:4])]
    flat = wide(spark, np.ones((4, 4)))
    assert not dense(pearson_clr(flat, 4, tile), (4, 4)).any() and not dense(pearson_stouffer(flat, 4, tile), (4, 4)).any()


@pytest.mark.parametrize("width", range(1, 12))
def test_band_keeps_each_pair_once(spark, width):
    kept = L.banded(L.fixed_grid(spark, width, width, 1, 1), width).collect()
    assert len({(min(t["r"], t["c"]), max(t["r"], t["c"])) for t in kept}) == len(kept) == width * (width + 1) // 2


def test_tiles(spark):
    a = np.arange(35.0).reshape(5, 7) + 1
    tiles = L.tiles_of(M.to_long(wide(spark, a)), 2, 3)
    assert tiles.count() == 9 and (dense(L.cells_of(tiles).filter("value <> 0"), (5, 7)) == a).all()
    assert [r["row_off"] for r in L.by_offsets(L.fixed_grid(spark, 5, 7, 2, 3)).collect()] == [0] * 3 + [2] * 3 + [4] * 3


def test_blocks_are_exchanged_with_their_tiles(spark):
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(5) for c in range(7)], "row_id long, col_id long, value double")
    tiles = L.tiles_of(cells, 2, 3)
    got = {(x["row_id"], x["col_id"]): x["value"] for x in L.cells_of(L.transposed(tiles)).collect()}
    assert {k: v for k, v in got.items() if k[0] < 7 and k[1] < 5} == {(c, r): 10.0 * r + c for r in range(5) for c in range(7)}
    assert [*tiles.columns] == L.transposed(tiles).columns
    back = L.transposed(L.transposed(tiles))
    key = ["r", "c"]
    assert back.orderBy(key).collect() == tiles.orderBy(key).collect()
