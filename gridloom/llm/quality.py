"""Quality rules with cross-document line frequency, in Spark expressions only.

Base rules count words, symbols, repeated lines and repeated 8-word windows in each text. The method's own rule
hashes normalised lines and counts, for each host (source), the distinct documents that hold a line. Lines above the
limits are boilerplate and are removed, wherever they stand; a document of which too little is left is rejected.

Documents whose normalised lines make the same text are copies, and count as one: a text that a host holds a
thousand times would otherwise vanish with all its copies before dedup could keep one. Lines travel as
hashes, are aggregated before each shuffle, and are joined back by equi-joins that adaptive execution can split, so
neither a host with a third of all rows nor a line found everywhere lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACES, fresh, let, materialize, release, rewritten, text_of

WINDOW, MIN_WORDS, MOST_REPEATED = 8, 20, 30
#: A line is above the limits if more documents of its host hold it than LINE_DOCS and than LINE_SHARE of the host's documents.
LINE_DOCS, LINE_SHARE = 10, 0.005
#: A document is depleted if less than that share of its words is left.
LEAST_LEFT = 0.2


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES, -1), "")


def _repeated(words: Column, window: int) -> Column:
    """Words that lie in a window found twice or more. Most texts have none, which a hash set shows."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, other: F.coalesce(F.get(s, other)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last"))
        return let(pairs, lambda s: F.aggregate(starts(s), start, step, lambda a: a["n"]))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(found)


def normalised(text: Column) -> Column:
    """Case, digits and white space don't tell lines apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), SPACES, " "))


def line_key(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def _worded(lines: Column) -> Column:
    return F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def profile(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, host, raw_key (of the text), text_key (of its normalised lines), the base counts and the lines (key, n_words) of each row of docs."""
    text = text_of()
    stats = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w, window).cast("long").alias("n_repeat_words")))
    lines = let(_worded(F.split(text, "\n", -1)), lambda a: let(F.transform(a, normalised), lambda plain: F.struct(
        (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"), F.xxhash64(F.array_join(plain, " ")).alias("text_key"),
        F.transform(a, lambda line, i: F.struct(F.xxhash64(plain[i]).alias("key"), F.size(words_of(line)).alias("n_words"))).alias("lines"))))
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    out = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("raw_key"), stats.alias("s"), lines.alias("l"), symbols.alias("n_symbols"))
    return out.select("doc_id", "host", "raw_key", "s.*", "l.*", "n_symbols")


def frequent_lines(rows: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """host, key of the lines above the limits. rows: those of profile()."""
    met = rows.select("host", "text_key", F.explode(F.array_distinct("lines.key")).alias("key")).distinct()
    counts = met.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > line_docs)
    hosts = materialize(rows.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")), "quality-hosts")
    frequent = materialize(counts.join(hosts, "host").filter(F.col("n_docs") > line_share * F.col("host_docs")).select("host", "key"), "quality-lines")
    release(hosts)
    return frequent


def _judged(docs: DataFrame, least_left: float, limits: dict) -> DataFrame:
    rows = materialize(profile(docs).withColumn("rid", F.monotonically_increasing_id()), "quality-rows")
    frequent = frequent_lines(rows, **limits)
    hit = rows.select("rid", "host", F.explode("lines").alias("line")).select("rid", "host", "line.key", "line.n_words").join(frequent, ["host", "key"])
    gone = materialize(hit.groupBy("rid").agg(F.sum("n_words").alias("n_removed_words"), F.collect_set("key").alias("removed")), "quality-gone")
    out = rows.drop("lines").join(gone, "rid", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words") >= least_left * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def quality(docs: DataFrame, least_left: float = LEAST_LEFT, **limits) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words.

    Null text counts as empty and fails (no words); null sources are one host. Rows that repeat get equal
    verdicts. Columns besides doc_id, text and source aren't read. An empty table gives an empty result.
    """
    return _judged(docs, least_left, limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def keep_good(docs: DataFrame, least_left: float = LEAST_LEFT, **limits) -> DataFrame:
    """docs without the rejected rows, their frequent lines removed and n_chars, where there is one, counted anew.

    Null, empty and blank texts are rejected, texts of any length are read whole. Rows that repeat share a verdict and all stay or
    all go; rows that share an id are told apart by source and text. All columns stay, whatever their names. An empty table gives an empty result.
    """
    own, at, who, gone = fresh(docs, "own", "at", "who", "gone")
    ruled = _judged(docs, least_left, limits).filter("kept").select(F.col("doc_id").alias(who), F.col("raw_key").alias(own), F.col("host").alias(at), F.col("removed").alias(gone)).dropDuplicates([who, own, at])
    same = F.col("doc_id").eqNullSafe(F.col(who)) & (F.xxhash64(text_of()) == F.col(own)) & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(at))
    out = docs.join(ruled, same)
    left = F.array_join(F.filter(F.split(text_of(), "\n", -1), lambda line: ~(line.rlike(r"[^\x20\x09-\x0D]") & F.array_contains(F.col(gone), line_key(line)))), "\n")
    return rewritten(out, docs, F.col(gone).isNotNull(), left)
