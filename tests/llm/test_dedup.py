"""Exact and near dedup against brute force, and on edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm.components import connected_components
from gridloom.llm.exact_dedup import exact_dedup, keep_first
from gridloom.llm.simhash import _met, _picks, keep_nearest_first, links, near_duplicates

SCHEMA = "doc_id long, text string, name string, bucket int, fp long"
EDGES = [(5, None), (2, ""), (9, " \t\n "), (4, "one"), (3, "one  two"), (1, "one\n\ttwo"), (8, "one two "), (8, "one two "), (None, "one two"), (7, "é" * 3000), (6, "é" * 3000), (10, "é" * 2999 + "e"), (11, "x " * 40_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], SCHEMA)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("hash_bits", [64, 2])
def test_exact(spark, hash_bits):
    rng = random.Random(1)
    rows = EDGES + [(100 + i, "".join(rng.choice("ab \n") for _ in range(rng.choice([3, 40, 70])))) for i in range(150)]
    rows += [(300 + i, rows[rng.randrange(len(rows))][1]) for i in range(60)]
    got = exact_dedup(frame(spark, rows), block_bytes=16, hash_bits=hash_bits).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((str(i), str(min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert len({(r.block_level, r.block_name) for r in got}) == len(groups)


def test_exact_keeps_one_row_of_each_text(spark):
    out = keep_first(frame(spark, EDGES))
    assert out.columns == ["doc_id", "text", "name", "bucket", "fp"]
    kept = sorted((str(r.doc_id), norm(r.text)) for r in out.collect())
    assert len(kept) == len({norm(t) for _, t in EDGES}) == len({t for _, t in kept})


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup(none).count() == near_duplicates(none).count() == keep_first(none).count() == keep_nearest_first(none).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance=4):
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_near(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta"]
    rows = list(EDGES)
    for i in range(60):
        text = [rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.choice([2, 5, 120]))]
        rows.append((1000 + i, " ".join(text)))
        text[rng.randrange(len(text))] = "changed"
        rows.append((2000 - i, " \n".join(text)))
    got = {}
    for r in near_duplicates(frame(spark, rows)).collect():
        got.setdefault(str(r.doc_id), set()).add((r.fingerprint, r.component_id))
    values = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(values)
    least = {c: min((i for (i, _), x in zip(rows, root) if x == c and i is not None), default=None) for c in root}
    want = {}
    for (i, _), v, c in zip(rows, values, root):
        want.setdefault(str(i), set()).add((f"{v:016x}", least[c]))
    assert got == want


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_rows():
    rng = random.Random(12)
    rows = list(EDGES) + [(None, "only one without an id " * 3), (None, "another text without any id")]
    for i in range(30):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 30, 90, 300]))]
        rows.append((1000 + i, " ".join(words)))
        for k in range(3):
            for _ in range(rng.randrange(1, 2 + len(words) // 30)):
                words[rng.randrange(len(words))] = "changed"
            rows.append((3000 + 10 * i + k, " \n".join(words)))
    return rows


def brute_similar(texts):
    """The class of each text: tied by a Jaccard similarity of 0.8 or more of the sets of five-word shingles."""
    sets = [shingles(t) for t in texts]
    similar = lambda a, b: a == b or bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_similar_classes(spark):
    """Classes are tied by links of 0.8, all rows of a class reach each other, and (with a wide ring) none is lost."""
    rows = near_rows()
    root = brute_similar([t for _, t in rows])
    groups = {}
    for (i, t), r in zip(rows, root):
        groups.setdefault(r, []).append(i)
    want = sorted(str(min((x for x in g if x is not None), default=None)) for g in groups.values())
    assert 40 < len(want) < len(rows) - 20
    for options in ({"distance": 9, "rings": 4}, {"distance": 9, "rings": 4, "crowd": 2}):
        out = keep_nearest_first(frame(spark, rows), **options)
        assert out.columns == ["doc_id", "text", "name", "bucket", "fp"]
        assert sorted(str(r.doc_id) for r in out.collect()) == want


@pytest.mark.parametrize("crowd", [1024, 2])
def test_links_are_complete(spark, crowd):
    rng = np.random.default_rng(3)
    values = set(rng.integers(0, 1 << 63, 40).tolist())
    for v in list(values)[:8]:
        for _ in range(25):
            values.add(v ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 5), replace=False)))
    values = sorted(values)
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {(min(r), max(r)) for r in links(distinct, crowd=crowd).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(7, 7), (500, 500)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("crowd", [1024, 2])
def test_links_send_no_keys_through_the_driver(spark, tmp_path, crowd):
    """The keys are many rows a fingerprint, which Spark's sizes leave out: broadcast, those of 0.6 GB don't fit the driver."""
    spark.range(1000).select((F.col("id") * 16).alias("fp")).write.parquet(f"{tmp_path}/fps")
    plan = planned(links(spark.read.parquet(f"{tmp_path}/fps"), crowd=crowd))
    assert "SortMergeJoin" in plan
    assert not re.search(r"BroadcastHashJoin \[key_q|BroadcastNestedLoopJoin", plan)


def test_picks_and_sets_don_t_pass_through_the_driver(spark, tmp_path):
    """The same of the pipeline's stage: the keys of a node, and sets of shingles, which files hold many times smaller."""
    spark.range(1000).selectExpr("id AS node", "id * 16 AS fp", "5L AS n").write.parquet(f"{tmp_path}/one")
    assert not re.search(r"BroadcastHashJoin \[key", planned(_picks(spark.read.parquet(f"{tmp_path}/one"), 7, 0.8)))
    spark.range(1000).selectExpr("id AS node", "sequence(id, id + 300) AS shingles").write.parquet(f"{tmp_path}/sets")
    spark.range(1000).selectExpr("id AS a", "id + 1 AS b").write.parquet(f"{tmp_path}/pairs")
    plan = planned(_met(spark.read.parquet(f"{tmp_path}/pairs"), spark.read.parquet(f"{tmp_path}/sets")))
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
