"""Personal data and the terms that give it away, in Spark expressions only.

Base: e-mail addresses, IP addresses, card and phone numbers by pattern, each kind leftmost and non-overlapping, with
code-point offsets (matches and the text between them give the offsets).

Method: information-theoretic sanitisation. Each value found, and each domain of an e-mail address, is a protected entity.
Terms are counted with the entities of a text wherever they stand in it, over the corpus, copies of a text once: how far the
term t narrows down the entity c is their pointwise mutual information log2(N df(t,c) / (df(t) df(c))), as a share of the
entity's information log2(N / df(c)). Terms seen with an entity in enough different texts whose share exceeds a threshold are
generalised wherever they stand in the entity's texts, those above a higher one removed.

A share of g needs df(t) <= df(t,c) (N / df(c))^(1 - g), and df(t) is at least what the texts with entities show: that rules out
all but a few pairs before terms are counted over the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_shuffles, fresh, let, materialize, release, rewritten, running, text_of

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The contract's patterns; starts inside a run that its first character rules out are skipped, so no text takes quadratic time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Texts that must show a term with an entity; shares of the entity's information from which a term is generalised, and removed.
SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.95
#: A term: letters that nothing ties to an address or number, so that none is found inside a base span.
TERM_PATTERN = r"(?<![\p{L}0-9@._%+-])\p{L}{2,}+(?![0-9@_%+-]|\.\S)"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(digits, size - i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z")
    size = F.length(_digits(match))
    return size.between(10, 15) if kind == "phone" else F.when(size.between(14, 19), let(_digits(match), _luhn)).otherwise(F.lit(False))


def places(text: Column, pattern: str) -> Column:
    """start, end (code points), from, to (bytes), value of each match in text."""

    def build(matches: Column, between: Column) -> Column:
        steps = F.transform(matches, lambda m, i: F.struct((F.length(m) + F.length(between[i])).alias("c"), (F.octet_length(m) + F.octet_length(between[i])).alias("b")))
        zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("b"))
        merge = lambda a, x: F.struct((a["c"] + x["c"]).alias("c"), (a["b"] + x["b"]).alias("b"))

        def body(before) -> Column:
            def one(m: Column, i: Column) -> Column:
                def at(sums: Column) -> Column:
                    c, b = sums["c"] + F.length(between[i]), sums["b"] + F.octet_length(between[i])
                    return F.struct(c.alias("start"), (c + F.length(m)).alias("end"), b.alias("from"), (b + F.octet_length(m)).alias("to"), m.alias("value"))

                return let(before(i), at)

            return F.transform(matches, one)

        return running(steps, zero, merge, body)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda b: build(m, b))))


def _spans_of(text: Column, i: int, kind: str) -> Column:
    def span(m: Column) -> Column:
        entity = F.concat(F.lit(kind + ":"), F.lower(m["value"]) if kind in ("email", "ip") else _digits(m["value"]))
        return F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), m["from"].alias("from"), m["to"].alias("to"), entity.alias("entity"))

    kept = F.filter(places(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    return F.coalesce(F.when(text.rlike(NEEDS[kind]), F.transform(kept, span)), F.array())


def _spans(text: Column) -> Column:
    """All base spans in order of start, then kind, each with its entity."""
    return F.sort_array(F.concat(*[_spans_of(text, i, kind) for i, kind in enumerate(KINDS)]))


def _entities(spans: Column) -> Column:
    """The different entities of a text: the values, and the domains of addresses."""
    values = F.transform(spans, lambda s: s["entity"])
    domains = F.transform(F.filter(values, lambda e: e.startswith("email:")), lambda e: F.concat(F.lit("domain:"), F.substring_index(e, "@", -1)))
    return F.array_distinct(F.concat(values, domains))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0)))


def term_counts(docs: DataFrame, copies: bool = True) -> DataFrame:
    """term, df_term: the different texts of docs that hold each term. copies: whether texts repeat; then one of each is taken first.

    A task adds up its counts before they travel, so what is shuffled is the vocabulary of each task and, of texts that repeat, the
    texts: less than the words of every text, which would have to meet their copies.
    """
    texts = docs.select(F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))
    if copies:
        texts = texts.groupBy("text_key").agg(F.first("text").alias("text"))
    return texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_term"))


def disclosing(held: DataFrame, docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """entity, term, removed: the pairs above the threshold. held: text_key, text, spans of the rows of docs with a span."""
    texts = held.groupBy("text_key").agg(F.first("text").alias("text"), F.first("spans").alias("spans"))
    texts = materialize(texts.select("text_key", _entities(F.col("spans")).alias("entities"), "text"), "pii-texts")
    entities = texts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity")).filter(F.col("df_entity") >= support)
    entities = materialize(entities, "pii-entities")
    known = texts.select("text_key", F.explode("entities").alias("entity")).join(entities, "entity").select("text_key", "entity")
    known = materialize(known.groupBy("text_key").agg(F.collect_list("entity").alias("entities")), "pii-known")
    terms = texts.join(known.select("text_key"), "text_key", "left_semi").select("text_key", _terms(F.col("text")).alias("terms"))
    terms = materialize(terms, "pii-words")
    # A term must be in `support` of the texts with such entities, and its count there is the least that it can have.
    seen = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_least")).filter(F.col("df_least") >= support)
    n, most = docs.groupBy(F.xxhash64(text_of()).alias("text_key")).agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)), F.max("k")).first()
    pairs = terms.join(known, "text_key").select("entities", F.explode("terms").alias("term")).select(F.explode("entities").alias("entity"), "term")
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("df_both")).filter(F.col("df_both") >= support)
    may = F.col("df_least") <= F.col("df_both") * F.pow(F.lit(float(n)) / F.col("df_entity"), F.lit(1 - generalise)) * 1.000001
    pairs = materialize(pairs.join(entities, "entity").join(seen, "term").filter(may).select("entity", "term", "df_both", "df_entity"), "pii-candidates")
    for used in (texts, terms, known):
        release(used)
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(False).alias("removed"))
    drop_shuffles(docs.sparkSession)
    scored = pairs.join(term_counts(docs, most > 1), "term")
    share = F.when(F.col("df_entity") < n, F.log2(F.col("df_both") * F.lit(float(n)) / F.col("df_term") / F.col("df_entity")) / F.log2(F.lit(float(n)) / F.col("df_entity")))
    out = materialize(scored.withColumn("share", share).filter(F.col("share") >= generalise).select("entity", "term", (F.col("share") >= remove).alias("removed")), "pii-disclosing")
    release(pairs)
    drop_shuffles(docs.sparkSession)
    return out


def _found(docs: DataFrame, options: dict) -> DataFrame:
    """rid, doc_id, text_key, spans, terms to treat (start, end, from, to, removed) for each row of docs."""
    text = text_of()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64(text).alias("text_key"), let(text, lambda t: let(_spans(t), lambda s: F.struct(s.alias("spans"), F.when(F.size(s) > 0, t).alias("text")))).alias("x"))
    rows = materialize(rows.select("rid", "doc_id", "text_key", "x.*"), "pii-rows")
    held = rows.filter(F.size("spans") > 0)
    told = disclosing(held, docs, **options)
    mine = held.select("rid", F.explode(_entities(F.col("spans"))).alias("entity")).join(told, "entity").groupBy("rid", "term").agg(F.max("removed").alias("removed"))
    mine = materialize(mine, "pii-mine")
    found = held.select("rid", "text").join(mine.select("rid").distinct(), "rid", "left_semi").select("rid", places(F.col("text"), TERM_PATTERN).alias("terms"))
    # explode_outer: explode would have the places found once more, for every text, to leave out those without
    found = found.select("rid", F.explode_outer("terms").alias("t")).select("rid", F.lower("t.value").alias("term"), "t.start", "t.end", "t.from", "t.to").join(mine, ["rid", "term"])
    found = materialize(found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "from", "to", "removed"))).alias("hidden")), "pii-terms")
    none = F.array().cast("array<struct<start:int,end:int,from:int,to:int,removed:boolean>>")
    return rows.drop("text").join(found, "rid", "left").withColumn("hidden", F.coalesce("hidden", none))


def _written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, (*KINDS, TERM)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Null text counts as empty; such rows have no spans and the hash of the empty string. Rows that repeat
    are all returned. Columns besides doc_id and text aren't read. An empty table gives an empty result.
    """
    base = F.transform("spans", lambda s: s.dropFields("entity", "from", "to"))
    terms = F.transform("hidden", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return _found(docs, options).select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.sort_array(F.concat(base, terms))).alias("spans"), F.size("hidden").cast("long").alias("n_term"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """docs with personal data replaced by [EMAIL], [IP], [CARD], [PHONE], generalised terms by [TERM], and removed terms cut out.

    Of base spans that overlap, the first (then by kind) is replaced, and the rest of the others with it. Null, empty and other texts
    without a span stay as they are; texts of any length are read whole, rows that repeat are treated alike. All rows and columns
    stay, whatever their names. An empty table gives an empty result.
    """
    who, own, key, marks = fresh(docs, "who", "own", "key", "marks")
    found = _found(docs, options).filter((F.size("spans") > 0)).dropDuplicates(["doc_id", "text_key"])
    masks = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM)])
    mark = lambda s, kind, mask: F.struct(s["from"].alias("from"), kind.alias("kind"), s["to"].alias("to"), mask.alias("mask"))
    all_of = F.concat(F.transform("spans", lambda s: mark(s, s["kind"], masks[s["kind"]])), F.transform("hidden", lambda s: mark(s, F.lit(len(KINDS)), F.when(s["removed"], "").otherwise(masks[len(KINDS)]))))
    found = found.select(F.col("doc_id").alias(who), F.col("text_key").alias(key), F.sort_array(all_of).alias(marks))
    raw = F.col("text").cast("binary")  # slices of bytes: the place of a slice costs nothing

    def cut(marks: Column, before) -> Column:
        """The text between marks as it is, each mark's mask; of a mark that begins inside an earlier one, only what is beyond is cut."""
        gap = lambda at, to: F.when(to > at, F.substring(raw, at + 1, to - at).cast("string")).otherwise("")
        piece = lambda s, i: let(before(i), lambda at: F.concat(gap(at, s["from"]), F.when(s["from"] >= at, s["mask"]).otherwise("")))
        return F.concat(F.array_join(F.transform(marks, piece), ""), let(before(F.size(marks)), lambda at: gap(at, F.octet_length(raw))))

    whole = let(F.col(marks), lambda m: running(F.transform(m, lambda s: s["to"]), F.lit(0), lambda a, x: F.greatest(a, x), lambda before: cut(m, before)))
    marked = docs.withColumn(own, F.xxhash64(text_of()))
    out = marked.join(found, F.col("doc_id").eqNullSafe(F.col(who)) & (F.col(own) == F.col(key)), "left")
    return rewritten(out, docs, F.col(marks).isNotNull(), whole)
