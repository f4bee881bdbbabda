"""SimHash near-dedup with pigeonring filtering.

64-bit fingerprints link when they differ in at most `distance` bits. The fingerprint is seen as a ring of
distance + 1 segments. If two fingerprints link, then from some segment of the ring every chain of the next
l segments differs in at most l * distance / segments bits, for each l. So a pair is a candidate only if it
agrees on a first segment and differs in at most the budget of two on the first two. Keys hold two segments: the
index has one key per start, a query one for each change of the second segment within its budget, and an
equi-join finds them. Longer chains are tested, budget by budget, before the full Hamming distance.

A key shared by more than `crowd` fingerprints is not compared within: its chain is prolonged by another
segment, with the changes that the longer budget allows, until a key is rare or all but one segment is in it
(at most 2^12 or 2^13 distinct fingerprints then). That is exact too, so nothing is capped. Equal fingerprints
are one node from the start, and components are found without leaving DataFrames.

similar_classes() joins by Jaccard similarity: several rings, each from other hashes of the same shingles, find the
candidates with a distance wide enough for the similarity, and the shingle sets themselves decide.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_shuffles, fresh, materialize, named, release, spread
from gridloom.llm.components import connected_components

BITS, DISTANCE, SEED, CROWD = 64, 4, 42, 1024
#: Near copies by similarity: words a shingle, least Jaccard similarity, rings, bits in which one of them may differ.
WIDTH, SIMILARITY, RINGS, NEAR = 5, 0.8, 4, 7
#: The golden ratio and the multipliers of a well-known 64-bit finaliser.
STEP, MIXERS = 0x9E3779B97F4A7C15, (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: The number of a start stands above the bits of its key.
START = 58


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingles(words: list[bytes], width: int):
    """The hashes of the shingles of width words, some at a time; of fewer words, of the whole sequence; of none, nothing."""
    line, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        if words:
            yield np.array([hash_of(line, SEED)], np.uint64)
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = len(words) - width + 1
    for at in range(0, n, 1 << 15):
        to = min(n, at + (1 << 15))
        yield np.array([hash_of(line[i:j], SEED) for i, j in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)], np.uint64)


def _majority(parts) -> int:
    """Each bit that over half the hashes have; 0 of no hashes."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for some in parts:
        n += len(some)
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int) -> int:
    return _majority(_shingles(_words(text), width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(text.as_py(), width) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Ring:
    """The ring of segments: widths, offsets, budgets, and keys as Columns."""

    def __init__(self, distance: int):
        if not 0 < distance < 10:
            raise ValueError("a key holds its start and all segments but one, so the distance is from 1 to 9")
        self.distance, self.n = distance, distance + 1
        self.widths = [BITS // self.n + (i < BITS % self.n) for i in range(self.n)]
        self.offsets = [sum(self.widths[:i]) for i in range(self.n)]

    def width(self, start: int, length: int) -> int:
        return sum(self.widths[(start + i) % self.n] for i in range(length))

    def budget(self, length: int) -> int:
        return length * self.distance // self.n

    def mask(self, start: Column, length: int) -> Column:
        masks = [(1 << self.width(s, length)) - 1 for s in range(self.n)]
        masks = [F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks]
        return masks[0] if BITS % self.n == 0 else F.element_at(F.array(*masks), start + 1)

    def rotated(self, value: Column, start: Column, back: bool = False) -> Column:
        """The bits of value from the first segment on, at the bottom; back undoes that."""
        by = F.element_at(F.array(*[F.lit((BITS - o) % BITS if back else o) for o in self.offsets]), start + 1)
        return F.call_function("shiftrightunsigned", value, by).bitwiseOR(F.when(by == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", value, 64 - by)))

    def changes(self, start: int, length: int, most: int) -> list[int]:
        """Sets of at most so many bits in the last segment of a chain, as masks."""
        low, high = self.width(start, length - 1), self.width(start, length)
        return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(low, high), k)]

    def key(self, start: Column, length: int) -> Column:
        return F.call_function("shiftleft", start.cast("long"), F.lit(START)).bitwiseOR(self.rotated(F.col("fp"), start).bitwiseAND(self.mask(start, length)).bitwiseXOR(F.col("changed")))

    def viable(self, differ: Column, start: Column) -> Column:
        """differ: the bits in which two rotated values differ. Every chain from start is within its budget; the longest is the whole fingerprint."""
        test = F.lit(True)
        for length in range(2, self.n + 1):
            test = test & (F.bit_count(differ.bitwiseAND(self.mask(start, length))) <= self.budget(length))
        return test


def _start(key: Column) -> Column:
    return F.shiftrightunsigned(key, START).cast("int")


def links(distinct: DataFrame, distance: int = DISTANCE, crowd: int = CROWD, apart: bool = False) -> DataFrame:
    """u, v: pairs of the distinct values fp (signed longs) that differ in at most distance bits, each pair at least once.

    distinct must be a written table or cheap to compute: it is read for each side of the join. apart: rows have node and root as
    well, values may repeat, and u, v are the nodes of rows with different roots; others are left out inside the join.
    """
    ring, own = Ring(distance), ["node", "root"] if apart else []
    starts = [(s << START) | c for s in range(ring.n) for c in ring.changes(s, 2, ring.budget(2))]
    zero = F.lit(0).cast("long")
    index = distinct.select("fp", *own, F.explode(F.lit(list(range(ring.n)))).alias("start"), zero.alias("changed"))
    query = distinct.select("fp", *own, F.explode(F.lit(starts)).alias("packed"))
    query = query.select("fp", *own, F.shiftright("packed", START).cast("int").alias("start"), F.col("packed").bitwiseAND((1 << START) - 1).alias("changed"))
    found = None
    for length in range(2, ring.n):
        index = index.select("fp", *own, "start", "changed", ring.key(F.col("start"), length).alias("key"))
        query = query.select("fp", *own, "start", "changed", ring.key(F.col("start"), length).alias("key"))
        crowded = None
        if length < ring.n - 1:
            crowded = materialize(index.groupBy("key").count().filter(F.col("count") > crowd).select("key"), "simhash-crowded")
            if crowded.isEmpty():
                crowded = None
        rare_i, rare_q = (index, query) if crowded is None else (index.join(crowded, "key", "left_anti"), query.join(crowded, "key", "left_anti"))
        side = lambda rare, mark: rare.select(*[c.alias(n + mark) for n, c in (("key", F.col("key")), ("turned", ring.rotated(F.col("fp"), F.col("start"))), *((o, F.col(o)) for o in own))])
        start, turned = _start(F.col("key_q")), (F.col("turned_q"), F.col("turned_x"))
        first = turned[0] < turned[1]
        if apart:
            first = (F.col("root_q") != F.col("root_x")) & (first | (turned[0] == turned[1]) & (F.col("node_q") < F.col("node_x")))
        pairs = spread(side(rare_q, "_q")).join(side(rare_i, "_x"), (F.col("key_q") == F.col("key_x")) & first & ring.viable(turned[0].bitwiseXOR(turned[1]), start))
        u, v = (F.col("node_q"), F.col("node_x")) if apart else (ring.rotated(t, start, back=True) for t in turned)
        pairs = pairs.select(u.alias("u"), v.alias("v"))
        found = pairs if found is None else found.unionByName(pairs)
        if crowded is None:
            break
        more = length + 1
        sets = [F.lit(ring.changes(s, more, most)) for s in range(ring.n) for most in range(ring.budget(more) + 1)]
        left = F.lit(ring.budget(more)) - F.bit_count("changed")
        index = index.join(crowded, "key", "left_semi").select("fp", *own, "start", "changed")
        query = query.join(crowded, "key", "left_semi").select("fp", *own, "start", "changed", F.explode(F.element_at(F.array(*sets), (F.col("start") * (ring.budget(more) + 1) + left + 1).cast("int"))).alias("next"))
        query = query.select("fp", *own, "start", F.col("changed").bitwiseOR(F.col("next")).alias("changed"))
    return found


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, copies (rows with the same fingerprint) for each row of docs.

    A-Z are lower-cased; shingles of width words, repeats included; texts with fewer words are one shingle;
    null, empty and blank texts have fingerprint zero and link like any other. component_id is the smallest
    doc_id reachable through links (null if no row of the component has an id). Rows that repeat, share ids or
    texts are all returned. Other columns aren't read. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, width), "simhash-rows")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "simhash-nodes")
    tied = connected_components(materialize(links(nodes.select("fp"), distance, crowd), "simhash-links"))
    tied = nodes.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = materialize(tied.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")  # apart, so that a hot root can be split
    tied = tied.join(ids, "root").select("fp", "component_id", "copies")
    return rows.join(tied, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def _remixed(hashes: np.ndarray, ring: int) -> np.ndarray:
    """Other hashes of the same shingles for each ring, by an invertible mixing of 64 bits."""
    if ring == 0:
        return hashes
    x = hashes ^ np.uint64(ring * STEP & (1 << 64) - 1)
    for factor in MIXERS:
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


def _shingle_set(words: list[bytes], width: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(words, width)]))


def _text_key(words: list[bytes]) -> bytes:
    """128 bits that stand for a sequence of words."""
    return xxhash.xxh128_digest(b"\n".join(words), SEED)


def _sketches(docs: DataFrame, width: int, rings: int) -> DataFrame:
    """doc_id, key (of the words), n (distinct shingles), fps (a fingerprint of the distinct shingles for each ring) of each row."""

    def run(batches):
        for batch in batches:
            keys, sizes, fps = [], [], []
            for text in batch.column("text"):
                words = _words(text.as_py())
                found = _shingle_set(words, width)
                keys.append(_text_key(words))
                sizes.append(len(found))
                fps.append(np.array([_majority([_remixed(found, ring)]) for ring in range(rings)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "key", "n", "fps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, key binary, n long, fps array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """key, shingles of each row of texts (text)."""

    def run(batches):
        for batch in batches:
            words = [_words(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([_text_key(w) for w in words], pa.binary()), pa.array([_shingle_set(w, width).view(np.int64) for w in words], pa.list_(pa.int64()))], ["key", "shingles"])

    return texts.mapInArrow(run, "key binary, shingles array<long>")


def _picks(one: DataFrame, distance: int, similarity: float) -> DataFrame:
    """a, b: of the nodes that share a key of two segments, each with the first of them, if the chains allow it. one: node, fp, n."""
    ring = Ring(distance)
    index = one.select("node", "fp", "n", F.explode(F.lit(list(range(ring.n)))).alias("start"), F.lit(0).cast("long").alias("changed")).select("node", "fp", "n", ring.key(F.col("start"), 2).alias("key"))
    first = index.groupBy("key").agg(F.min(F.struct("node", "fp", "n")).alias("f"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("key", "f")
    start = _start(F.col("key"))
    near = ring.viable(ring.rotated(F.col("fp").bitwiseXOR(F.col("f.fp")), start), start) & (F.least("n", "f.n") >= similarity * F.greatest("n", "f.n"))
    return spread(index).join(first, "key").filter((F.col("node") != F.col("f.node")) & near).select(F.col("node").alias("a"), F.col("f.node").alias("b"))


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common (shingles in both sets), both (the sum of their sizes) for each pair."""
    left, right = (sets.select(F.col("node").alias(node), F.col("shingles").alias(of)) for node, of in (("a", "of_a"), ("b", "of_b")))
    return pairs.join(spread(left), "a").join(spread(right), "b").select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("common"), (F.size("of_a") + F.size("of_b")).alias("both"))


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """u, v: the pairs a, b of nodes whose shingle sets have that Jaccard similarity or more. Only the texts of these nodes are read."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = materialize(nodes.join(ends, "node", "left_semi").select("node", "key", F.col("least").alias("who")), "near-held")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(held.select("who").distinct(), F.col("doc_id").eqNullSafe(F.col("who")), "left_semi")
    sets = materialize(_sets(texts.select("text"), width).join(held.select("key", "node"), "key").dropDuplicates(["node"]).select("node", "shingles"), "near-sets")
    met = _met(pairs, sets)
    out = materialize(met.filter(F.col("common") >= similarity * (F.col("both") - F.col("common"))).select(F.col("a").alias("u"), F.col("b").alias("v")), "near-ties")
    release(sets)
    return out


def similar_classes(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, distance: int = NEAR, rings: int = RINGS, crowd: int = CROWD) -> DataFrame:
    """doc_id, key (128 bits of the words) and root of the class of each row of docs: texts of a class are tied by links of that similarity.

    Two texts link if the Jaccard similarity of their sets of width-word shingles (A-Z in lower case; of fewer words the whole
    sequence is the one shingle) is at least `similarity` and the 64-bit fingerprints of the sets differ in at most `distance`
    bits in one of `rings` independent rings. Rings find candidates, pigeonring filtering prunes them, the sets decide.
    First each text meets one other of each of its keys, which ties large groups of near copies at the cost of a few pairs a text;
    then all pairs of texts that are still apart are looked for, and no others, so no link is lost and no group emits its pairs.
    Equal word sequences are one node; null, empty and blank texts are equal.
    """
    rows = materialize(_sketches(docs, width, rings).withColumn("rid", F.monotonically_increasing_id()), "near-rows")
    nodes = materialize(rows.groupBy("key").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fps").alias("fps")), "near-nodes")
    ringed = lambda found: [found(nodes.select("node", "n", F.col("fps")[ring].alias("fp"))) for ring in range(rings)]
    picks = materialize(reduce(DataFrame.unionByName, ringed(lambda one: _picks(one, distance, similarity))).distinct(), "near-picks")
    tied = _similar(picks, nodes, docs, width, similarity)
    release(picks)
    roots = materialize(connected_components(tied), "near-roots")
    drop_shuffles(docs.sparkSession)
    rooted = materialize(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-nodes")
    sizes = lambda node, size: rooted.select(F.col("node").alias(node), F.col("n").alias(size))
    apart = [materialize(links(rooted.select("node", "root", F.col("fps")[ring].alias("fp")), distance, crowd, apart=True).distinct(), "near-apart") for ring in range(rings)]
    drop_shuffles(docs.sparkSession)
    apart = reduce(DataFrame.unionByName, apart).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    apart = apart.join(sizes("a", "n_a"), "a").join(sizes("b", "n_b"), "b").filter(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    more = _similar(materialize(apart.select("a", "b"), "near-apart"), rooted, docs, width, similarity)
    roots = materialize(connected_components(tied.unionByName(more)), "near-roots")
    tied = nodes.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    return rows.join(tied, "key").select("doc_id", "key", "root")


def keep_nearest_first(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each of similar_classes(): that with the smallest doc_id, null ids last.

    Null, empty and blank texts are equal, so one of them stays; texts of any length are read whole. Rows that share an id are told
    apart by their words, and one of rows equal in both stays. All columns stay, whatever their names. An empty table gives an empty result.
    """
    found = materialize(similar_classes(docs, **options), "near-found")
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("s"))
    who, own, key = fresh(docs, "who", "own", "key")
    stay = materialize(stay.select(F.col("s.doc_id").alias(who), F.col("s.key").alias(key)), "near-stay")
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col(who))
    if found.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.join(stay, mine, "left_semi")

    @F.pandas_udf("binary")
    def keyed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: _text_key(_words(text)))

    out = docs.withColumn(own, keyed(F.col("text").cast("string"))).join(stay, mine & (F.col(own) == F.col(key)), "left_semi")
    return out.dropDuplicates(["doc_id", own]).select(*map(named, docs.columns))
