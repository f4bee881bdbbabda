"""Language-model scores from a log-frequency Bloom filter.

Unigrams and bigrams are 64-bit hashes. A count c in the training texts is kept as the level 1 + floor(log2 c): an n-gram
goes into the filter once for each level up to its own, and its level is read back by probing level after level
until a probe fails. The filter grows with the n-grams and is cut into ranges of hashes, so no task, and not the driver, holds more
than one range: each chunk of texts packs its distinct n-grams with their counts by range, each range merges what all chunks
sent, fills its part of the filter, and answers each chunk with the levels of what it asked for; an equi-join by chunk
brings the answers back to the texts. Bigram and unigram estimates are interpolated; the weights, one for each level of the
context, come from deleted interpolation over all training texts.

Base scores need exact counts: the HEAD most frequent tokens are broadcast, all others are counted by an equi-join.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_shuffles, materialize, release

MOST_BITS, LEAST_BITS, WISHED_BITS, PROBES = 1 << 29, 8, 12, 4
HEAD, PART = 100_000, 1 << 20
#: Tokens of a chunk of texts (a longer text is a chunk of its own), and of training for each range of the filter.
CHUNK, SPAN = 700_000, 1 << 20
#: Longer tokens aren't broadcast, which bounds the head's bytes too.
HEAD_BYTES = 64
#: The token that ends a text, and stands before its first word: no word holds a space.
END = b" "


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unigrams(words: np.ndarray) -> np.ndarray:
    return mixed(words ^ np.uint64(0x5851F42D4C957F2D))


def bigrams(words: np.ndarray) -> np.ndarray:
    """Keys of the adjacent pairs of hashed words."""
    return mixed(mixed(words[:-1]) * np.uint64(0x9E3779B97F4A7C15) + words[1:])


class Words(dict):
    """word -> its place in the arrays hash, known (count in `head`, -1 if not there) and level (of the unigram, once looked up).

    Emptied between runs of texts when it has grown to `most` words.
    """

    def __init__(self, head: dict[bytes, int] | None = None, most: int = 300_000):
        super().__init__()
        self.head, self.most, self.looked_up = head or {}, most, 0
        self.hash, self.known, self.level = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at == len(self.hash):
            self.hash, self.known, self.level = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.known, self.level))
        self.hash[at] = xxhash.xxh64_intdigest(word, 1)
        self.known[at] = self.head.get(word, -1)
        return at

    def places(self, texts: list[list[bytes]]) -> tuple[np.ndarray, list[bytes]]:
        """END, the words of the first text, END, those of the next, END, and so on: as places and as they are."""
        if len(self) >= self.most:
            self.clear()
            self.looked_up = 0
        flat = [END]
        for words in texts:
            flat += words
            flat.append(END)
        return np.fromiter(map(self.__getitem__, flat), np.int64, len(flat)), flat

    def hashed(self, texts: list[list[bytes]]) -> np.ndarray:
        places = self.places(texts)[0]
        return self.hash[places]


def runs(batch: pa.RecordBatch, column: str = "text", most: int = PART):
    """Slices of a batch with about so many characters, a longer text alone, and the words of their texts."""
    at, size, words = 0, 0, []
    for i, text in enumerate(batch.column(column)):
        text = text.as_py()
        if words and size + len(text or "") > most:
            yield batch.slice(at, i - at), words
            at, size, words = i, 0, []
        size += len(text or "")
        words.append(words_of(text))
    if words:
        yield batch.slice(at), words


@dataclass
class Filter:
    """bits: the bit array as bytes, in 2**ranges equal parts, one for each range of keys."""

    bits: np.ndarray
    ranges: int

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of (key, level): the first bit inside its range, and the step to the next. keys: the 32 bits after those that give the range."""
        h = mixed(keys.astype(np.uint64) * np.uint64(64) + np.uint64(level))
        return (h & np.uint64(size - 1)).astype(np.int64), (h >> np.uint64(32) | np.uint64(1)).astype(np.int64)

    def levels(self, keys: np.ndarray, most: int = 48) -> np.ndarray:
        """The level of each 64-bit key, 0 if it isn't there."""
        out = np.zeros(len(keys), np.int64)
        if not self.bits.size:
            return out
        size = self.bits.size * 8 >> self.ranges
        base, short = split(keys, self.ranges)
        base, at = base.astype(np.int64) * size, np.arange(len(keys))
        for level in range(1, most):
            place, step = self.places(short, level, size)
            held = np.ones(len(at), bool)
            for i in range(PROBES):
                live = np.flatnonzero(held) if i else slice(None)
                bit = base[live] + ((place[live] + i * step[live]) & (size - 1))
                held[live] = self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
            at, base, short = at[held], base[held], short[held]
            if not at.size:
                break
            out[at] = level
        return out

    @staticmethod
    def counts(levels: np.ndarray) -> np.ndarray:
        """The expected count at each level: the middle of the counts that it stands for."""
        power = np.exp2(np.maximum(levels, 1) - 1.0)
        return np.where(levels > 0, (3 * power - 1) / 2, 0.0)


def split(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each 64-bit key, and the 32 bits after it."""
    return (keys >> np.uint64(64 - ranges)).astype(np.uint32), (keys >> np.uint64(32 - ranges)).astype(np.uint32)


def token_counts(training: DataFrame, flush: int = 400_000) -> DataFrame:
    """token, n over all training texts, END included; each task adds up its own before the shuffle."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([*counts.keys()], pa.binary()), pa.array([*counts.values()], pa.int64())], ["token", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                counts.update(words_of(text.as_py()))
                counts[END] += 1
                if len(counts) > flush:
                    yield rows()
        yield rows()

    return training.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def ngram_counts(training: DataFrame, ranges: int, buffer: int = 3_000_000) -> DataFrame:
    """part, keys, counts (packed), levels (n-grams at each level): the unigrams and bigrams of each range of hashes, merged."""

    def run(batches):
        known, waiting, size = Words(), [], 0

        def blobs():
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            part, short = split(keys, ranges)
            present, first = np.unique(part, return_index=True)
            edges = [*first.tolist(), len(keys)]
            rows = [(short[a:b].astype("<u4").tobytes(), counts[a:b].astype("<u4").tobytes()) for a, b in zip(edges, edges[1:])]  # noqa: B905
            return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int64)), pa.array([k for k, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.binary())], ["part", "keys", "counts"])

        for batch in batches:
            for _, texts in runs(batch):
                words = known.hashed(texts)
                waiting += [unigrams(words[1:]), bigrams(words)]
                size += 2 * len(words)
                if size > buffer:
                    yield blobs()
                    waiting, size = [], 0
        if waiting:
            yield blobs()

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("keys")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("counts")])
        unique, where = np.unique(keys, return_inverse=True)
        sums = np.bincount(where, counts, len(unique))
        level = 1 + np.floor(np.log2(sums)).astype(np.int64)
        return pa.table({"part": pa.array([key[0].as_py()]), "keys": pa.array([unique.astype("<u4").tobytes()], pa.binary()), "level": pa.array([level.astype(np.uint8).tobytes()], pa.binary()), "tally": pa.array([np.bincount(level, minlength=64)[:64].tolist()], pa.list_(pa.int64()))})

    packed = training.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "part long, keys binary, counts binary")
    return packed.groupBy("part").applyInArrow(merged, "part long, keys binary, level binary, tally array<long>")


def build_filter(training: DataFrame, tokens: int, most_bits: int = MOST_BITS) -> tuple[Filter, int]:
    """For a caller that wants it in one piece of bounded size (scores don't: see levelled()): the filter, and the least level kept. tokens: tokens of the training texts, which sets the number of ranges that are merged apart."""
    ranges = min(20, max(8, int(tokens >> 15).bit_length()))
    counted = materialize(ngram_counts(training, ranges), "lm-ngrams")
    tally = {r["level"]: r["n"] for r in counted.select(F.posexplode("tally").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()}

    def items(least: int) -> int:
        return sum(n * (level - least + 1) for level, n in tally.items() if level >= max(1, least))

    least = 1
    while items(least) * LEAST_BITS > most_bits:
        least += 1
    total = 1 << max(ranges + 6, (max(1, items(least) * WISHED_BITS) - 1).bit_length())
    size = min(total, max(most_bits, 1 << (ranges + 6))) >> ranges

    def run(batches):
        for batch in batches:
            out = []
            for keys, level in zip(batch.column("keys"), batch.column("level"), strict=True):
                keys, level = np.frombuffer(keys.as_buffer(), "<u4"), np.frombuffer(level.as_buffer(), np.uint8)
                bits = np.zeros(size, np.bool_)
                for k in range(least, int(level.max(initial=0)) + 1):
                    place, step = Filter.places(keys[level >= k], k - least + 1, size)
                    for i in range(PROBES):
                        bits[(place + i * step) & (size - 1)] = True
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(out, pa.binary())], ["part", "bits"])

    whole = np.zeros(size * (1 << ranges) // 8, np.uint8)
    for row in counted.select("part", "keys", "level").mapInArrow(run, "part long, bits binary").toLocalIterator(prefetchPartitions=True):
        at = row["part"] * size // 8
        whole[at : at + size // 8] = np.frombuffer(row["bits"], np.uint8)
    return Filter(whole, ranges), least


def filled(keys: np.ndarray, level: np.ndarray) -> Filter:
    """One range of the filter, with WISHED_BITS or more for each item. keys: the 32 bits after those that give the range."""
    items = int(level.sum(dtype=np.int64))
    size = 1 << max(6, (max(1, items * WISHED_BITS) - 1).bit_length())
    bits = np.zeros(size, np.bool_)
    for k in range(1, int(level.max(initial=0)) + 1):
        place, step = Filter.places(keys[level >= k], k, size)
        for i in range(PROBES):
            bits[(place + i * step) & (size - 1)] = True
    return Filter(np.packbits(bits, bitorder="little"), 0)


def asked(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of a chunk: its unigrams as hashes are numbered, then its bigrams; the number of each adjacent pair; the order by hash."""
    pairs, where = np.unique(bigrams(hashes[places]), return_inverse=True)
    keys = np.concatenate([unigrams(hashes), pairs])
    return keys, where + len(hashes), np.argsort(keys, kind="stable")


def squeezed(values: np.ndarray) -> bytes:
    """32-bit values, compressed byte by byte of all, after their number."""
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def restored(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(pa.decompress(data[4:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel()


PIECES = "chunk long, at int, doc_id long, held_out boolean, n_tokens long, met long, total double, tail array<binary>, places binary, words binary, texts binary"


def pieces(chosen: DataFrame, known, chunk: int = CHUNK) -> DataFrame:
    """The texts of each chunk, numbered (at), and for the chunk itself (at -1) the places of all its tokens (squeezed), the hashes of its words, and
    twice the length of each of its texts, one more if it is learned from (squeezed). known: broadcast head of the vocabulary."""
    schema = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("met", pa.int64()), ("total", pa.float64()), ("tail", pa.list_(pa.binary())), ("places", pa.binary()), ("words", pa.binary()), ("texts", pa.binary())])

    def filled_up(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        number = TaskContext.get().partitionId() << 20
        words, at, size, flow, learned = Words(known.value, 1 << 62), 0, 0, [], []

        def ends() -> pa.RecordBatch:
            values = (squeezed(np.concatenate(flow)), words.hash[: len(words)].astype("<u8").tobytes(), squeezed(np.concatenate(learned)))
            return filled_up(1, chunk=pa.array([number]), at=pa.array([-1], pa.int32()), **{k: pa.array([x], pa.binary()) for k, x in zip(("places", "words", "texts"), values, strict=True)})

        for batch in batches:
            for rows, texts in runs(batch):
                places, flat = words.places(texts)
                lengths = np.array([len(t) + 1 for t in texts])
                starts = np.cumsum(lengths) - lengths
                count = words.known[places[1:]]
                met = np.add.reduceat((count >= 0).astype(np.int64), starts)
                total = np.add.reduceat(np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.1), 0.0), starts)
                rest = np.flatnonzero(count < 0)
                tail = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(rest, starts), len(rest)).astype(np.int32)), pa.array([flat[i + 1] for i in rest.tolist()], pa.binary()))
                held = rows.column("held_out")
                yield filled_up(len(texts), chunk=pa.array([number] * len(texts)), at=pa.array(np.arange(at, at + len(texts), dtype=np.int32)), doc_id=rows.column("doc_id"), held_out=held, n_tokens=pa.array(lengths), met=pa.array(met), total=pa.array(total), tail=tail)
                flow.append(places[1:])
                learned.append(lengths * 2 + ~np.array(held.to_pylist(), bool))
                at, size = at + len(texts), size + len(places) - 1
                if size >= chunk:
                    yield ends()
                    number, words, at, size, flow, learned = number + 1, Words(known.value, 1 << 62), 0, 0, [], []
        if at:
            yield ends()

    return chosen.mapInArrow(run, PIECES)


def asking(chunks: DataFrame, ranges: int) -> DataFrame:
    """chunk, part, keys, counts: for each range, the gaps of a chunk's distinct n-grams and their counts in texts that are learned from (squeezed)."""

    def run(batches):
        for batch in batches:
            for chunk, places, words, texts in zip(*(batch.column(c) for c in ("chunk", "places", "words", "texts")), strict=True):
                hashes, texts = np.frombuffer(words.as_buffer(), "<u8"), restored(texts.as_py())
                places, train = np.concatenate([[0], restored(places.as_py())]), np.repeat(texts & 1, texts >> 1)
                keys, where, order = asked(hashes, places)
                counts = np.bincount(places[1:], train, len(keys)) + np.bincount(where, train, len(keys))
                part, short = split(keys[order], ranges)
                counts = counts[order].astype("<u4")
                del places, train, keys, where, order
                present, first = np.unique(part, return_index=True)
                edges = [*first.tolist(), len(part)]
                spans = [*zip(edges, edges[1:])]  # noqa: B905
                gaps = [squeezed(np.diff(short[a:b], prepend=short[:1] * 0)) for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()] * len(spans)), pa.array(present.astype(np.int64)), pa.array(gaps, pa.binary()), pa.array([squeezed(counts[a:b]) for a, b in spans], pa.binary())], ["chunk", "part", "keys", "counts"])

    return chunks.select("chunk", "places", "words", "texts").mapInArrow(run, "chunk long, part long, keys binary, counts binary")


def levelled(packed: DataFrame) -> DataFrame:
    """chunk, part, levels: the filter's answers, in the order of each chunk's n-grams. packed: chunk, part, keys, counts."""

    def run(table: pa.Table) -> pa.Table:
        asked_for = [np.cumsum(restored(x.as_py()), dtype=np.uint32) for x in table.column("keys")]
        counts = np.concatenate([restored(x.as_py()) for x in table.column("counts")])
        unique, where = np.unique(np.concatenate(asked_for), return_inverse=True)
        sums = np.bincount(where, counts, len(unique))
        seen = sums > 0
        part = filled(unique[seen], 1 + np.floor(np.log2(sums[seen])).astype(np.int64))
        levels = part.levels(unique.astype(np.uint64) << np.uint64(32)).astype(np.uint8)[where]
        edges = np.cumsum([0, *map(len, asked_for)]).tolist()
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "levels": pa.array([squeezed(levels[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())})  # noqa: B905

    return packed.groupBy("part").applyInArrow(run, "chunk long, part long, levels binary")


GRAMS = "chunk long, at int, doc_id long, held_out boolean, n_tokens long, met long, total double, codes array<int>, times array<int>"


def grams(texts: DataFrame, levels: DataFrame) -> DataFrame:
    """The texts of pieces() with how often each triple of levels occurs in them: those of the word before, the word and both, as a code."""

    def run(texts: pa.Table, levels: pa.Table) -> pa.Table:
        texts, levels = texts.sort_by("at"), levels.sort_by("part")
        hashes = np.frombuffer(texts.column("words")[0].as_buffer(), "<u8")
        places = np.concatenate([[0], restored(texts.column("places")[0].as_py())])
        keys, where, order = asked(hashes, places)
        level = np.zeros(len(keys), np.int64)
        level[order] = np.concatenate([restored(x.as_py()) for x in levels.column("levels")])
        code = level[places[:-1]] | level[places[1:]] << 6 | level[where] << 12
        lengths = texts.column("n_tokens").to_numpy()[1:].astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        both, times = np.unique(row << 18 | code, return_counts=True)
        offsets = pa.array(np.searchsorted(both >> 18, np.arange(len(lengths) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (both & (1 << 18) - 1, times)]
        out = texts.slice(1).drop_columns(["places", "words"])
        return out.append_column("codes", lists[0]).append_column("times", lists[1])

    return texts.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(run, GRAMS)


@dataclass
class Model:
    """tokens, types: of training; weights: of the bigram estimate, by level of the context."""

    tokens: int
    types: int
    weights: np.ndarray

    @staticmethod
    def parts() -> tuple[np.ndarray, ...]:
        """For each code of grams(): the expected count of the word, that of the word before (and its level), and that of both."""
        code = np.arange(1 << 18)
        before, one, both = code & 63, code >> 6 & 63, code >> 12
        return Filter.counts(one), Filter.counts(before), before, Filter.counts(both)

    def log10(self) -> np.ndarray:
        one, before, level, both = self.parts()
        weight = self.weights[level]
        return np.log10(weight * np.minimum(1.0, both / np.maximum(before, 1.0)) + (1 - weight) * (one + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def votes(self, times: np.ndarray) -> np.ndarray:
        """Deleted interpolation: by level of the context, tokens that the bigrams, and the unigrams, foretell better without themselves."""
        one, before, level, both = self.parts()
        pair = np.where(before > 1, np.minimum(1.0, np.maximum(both - 1, 0) / np.maximum(before - 1, 1)), 0.0)
        better = pair > np.maximum(one - 1, 0.1) / max(1, self.tokens)
        return np.stack([np.bincount(level, times * better, 64), np.bincount(level, times * ~better, 64)]).astype(np.int64)


def _held_out(folds: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def lm_scores(docs: DataFrame, folds: int = 10, head: int = HEAD, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Learned from rows whose crc32(doc_id) modulo folds is not 0; rows without doc_id are learned from. Null counts
    as empty, which is its end alone. Rows that repeat count and are returned each. Without training rows every
    count is 0. Columns besides doc_id and text aren't read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _held_out(folds).alias("held_out"))
    vocabulary = materialize(token_counts(chosen.filter("not held_out")), "lm-tokens")
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = vocabulary.filter(F.length("token") <= HEAD_BYTES).orderBy(F.desc("n"), "token").limit(head).collect()
    known = spark.sparkContext.broadcast({bytes(r["token"]): r["n"] for r in top})
    del top
    ranges = min(20, max(5, int(n // span).bit_length()))
    drop_shuffles(spark)
    found = materialize(pieces(chosen, known, chunk), "lm-pieces")
    levels = materialize(levelled(asking(found.filter("at = -1"), ranges)), "lm-levels")  # written, so that what was asked is dropped before the texts are shuffled
    drop_shuffles(spark)
    rows = materialize(grams(found.select("chunk", "at", "doc_id", "held_out", "n_tokens", "met", "total", "places", "words"), levels), "lm-rows")

    def voting(batches):
        times = np.zeros(1 << 18, np.int64)
        for batch in batches:
            times += np.bincount(batch.column("codes").flatten(), batch.column("times").flatten(), 1 << 18).astype(np.int64)
        votes = Model(n, v, np.zeros(64)).votes(times)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(votes[0]), pa.array(votes[1])], ["level", "pair", "one"])

    weights = np.zeros(64)
    for r in rows.filter("not held_out").select("codes", "times").mapInArrow(voting, "level long, pair long, one long").groupBy("level").agg(F.sum("pair"), F.sum("one")).collect():
        weights[r[0]] = r[1] / (r[1] + r[2] + 10)  # ten more for the unigrams keep the weight below one

    def scoring(batches):
        log10 = Model(n, v, weights).log10()
        for batch in batches:
            codes = batch.column("codes")
            sums = np.concatenate([[0.0], np.cumsum(log10[codes.flatten()] * batch.column("times").flatten())])
            edges = np.concatenate([[0], np.cumsum(codes.value_lengths())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sums[edges[1:]] - sums[edges[:-1]])], [*batch.schema.names[:-2], "score"])

    rid = (F.shiftleft("chunk", 22) + F.col("at")).alias("rid")  # a run has at most PART + 1 texts, a chunk fewer than CHUNK + PART + 1
    tails = materialize(found.filter(F.size("tail") > 0).select(rid, "tail"), "lm-tails")
    release(found)
    release(levels)
    drop_shuffles(spark)
    scored = rows.mapInArrow(scoring, GRAMS.replace("codes array<int>, times array<int>", "score double")).select("*", rid)
    tail = tails.select("rid", F.explode("tail").alias("token")).join(vocabulary, "token", "left")
    tail = tail.groupBy("rid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more"), F.count("n").alias("also"))
    out = scored.join(tail, "rid", "left")
    base = F.col("total") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + 0.1 * (v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("met") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
