"""Exact dedup by deterministic block naming.

The normalised text (each run of white space as one space) is cut into blocks of a fixed number of
bytes. Distinct blocks are sorted into integer names; adjacent names are then paired and the distinct
pairs sorted into names of the next level, until each document has one name. Two documents have the
same (level, name) exactly if their normalised texts are equal: no step trusts a hash.

Blocks travel once, grouped by their 64-bit hash with the least and greatest block of each hash. Where
those differ the hash isn't a key, and the blocks of that hash are named by their bytes (one more scan, in
which no other block carries its bytes). The hot blocks of large groups of copies are aggregated before the shuffle,
and are joined back by equi-joins that adaptive execution can split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import SPACES, fresh, materialize, named, release, text_of

BLOCK_BYTES = 1024
#: Names are sorted within so many buckets; a name is rank * BUCKETS + bucket, whatever the cluster's size.
BUCKETS = 1 << 16


def normalized(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), SPACES, " ")


def _blocks(text: Column, size: int) -> Column:
    """At least one block, so an empty text has a name too. Slices of bytes: the place of a block costs nothing."""
    raw = text.cast("binary")
    last = F.floor(F.greatest(F.octet_length(text) - 1, F.lit(0)) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Sorts distinct keys into integers, bucket by bucket."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))
    return distinct.withColumn("bucket", bucket).withColumn("name", (rank.cast("long") - 1) * BUCKETS + F.col("bucket")).drop("bucket")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """rid, doc_id, text_sha256, level, name for each row of docs. hash_bits: fewer let a test force equal hashes."""

    def key(block: Column) -> Column:
        return F.xxhash64(block) if hash_bits == 64 else F.pmod(F.xxhash64(block), F.lit(1 << hash_bits))

    base = docs.select("doc_id", normalized().alias("norm"))
    blocks = _blocks(F.col("norm"), block_bytes)
    rows = base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.transform(blocks, key).alias("hashes")).withColumn("n", F.size("hashes"))
    rows = materialize(rows, "dedup-rows")
    met = base.select(F.explode(blocks).alias("block")).withColumn("hash", key(F.col("block")))
    met = met.groupBy("hash").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    names = materialize(_named(met.select("hash", (F.col("low") != F.col("high")).alias("shared")), "hash"), "dedup-names")
    if names.filter("shared").isEmpty():
        parts = rows.select("rid", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "hash"))
        parts = parts.join(names, "hash").select("rid", "n", "pos", "name")
    else:  # blocks whose hash is shared are told apart by their bytes, which only they carry on; the few shared hashes go to the blocks
        release(rows)
        shared = materialize(names.filter("shared").select("hash", F.lit(True).alias("shared")), "dedup-shared")
        whole = base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.size(blocks).alias("n"), blocks.alias("blocks"))
        whole = whole.select("rid", "doc_id", "text_sha256", "n", F.posexplode("blocks").alias("pos", "block"))
        whole = whole.withColumn("hash", key(F.col("block"))).join(shared, "hash", "left")
        tie = F.when(F.col("shared"), F.concat(F.lit(b"="), F.col("block"))).otherwise(F.lit(b""))
        whole = materialize(whole.select("rid", "doc_id", "text_sha256", "n", "pos", "hash", tie.alias("tie")), "dedup-whole")
        rows = whole.filter("pos = 0").select("rid", "doc_id", "text_sha256", "n")
        parts = whole.join(_named(whole.select("hash", "tie").distinct(), "hash", "tie"), ["hash", "tie"]).select("rid", "n", "pos", "name")
    longest = rows.agg(F.max("n")).first()[0] or 1
    level, done = 0, []
    for level in range(math.ceil(math.log2(longest)) + 1):
        parts = materialize(parts, f"dedup-level{level}")
        done.append(parts.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        if level == math.ceil(math.log2(longest)):
            break
        odd = F.col("pos") % 2 == 1
        pairs = parts.filter("n > 1").groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.first("n").alias("n"), F.max(F.when(~odd, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b"))
        names = _named(pairs.select("a", "b").distinct(), "a", "b")
        parts = pairs.join(names, ["a", "b"]).select("rid", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name")
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    return rows.select("rid", "doc_id", "text_sha256").join(named, "rid")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, block_level, block_name: one row for each row of docs.

    Null text counts as empty, and empty texts are equal. Of equal texts the row with the smallest doc_id
    stays, null ids last; of rows that repeat an id and a text, one stays. Columns besides doc_id and text
    aren't read, whatever their names. An empty table gives an empty result.
    """
    rows = materialize(identities(docs, block_bytes, hash_bits), "dedup-ids")
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))
    groups = rows.groupBy("level", "name").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "dedup-groups")  # apart, so that a hot group can be split
    out = rows.join(groups, ["level", "name"])
    return out.select("doc_id", F.col("least.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("least.rid")).alias("kept"), "text_sha256", F.col("level").alias("block_level"), F.col("name").alias("block_name"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup() drops.

    Null and empty texts are equal, so one of them stays; texts of any length are read whole. Of equal texts the row with the smallest
    doc_id stays, and one of rows that repeat id and text. All columns stay, whatever their names. An empty table gives an empty result.
    """
    found = materialize(exact_dedup(docs), "dedup-found")
    own, who, sha = fresh(docs, "own", "who", "sha")
    stay = found.filter("kept").select(F.col("doc_id").alias(who), F.col("text_sha256").alias(sha))
    marked = docs.withColumn(own, F.sha2(normalized().cast("binary"), 256))
    out = marked.join(stay, F.col("doc_id").eqNullSafe(F.col(who)) & (F.col(own) == F.col(sha)), "left_semi")
    if not found.filter("not kept and doc_id <=> keep_id").isEmpty():
        out = out.dropDuplicates(["doc_id", own])
    return out.select(*map(named, docs.columns))
