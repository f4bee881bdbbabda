"""Vector bin packing of tokenised examples into training sequences, by the dot-product heuristic.

Each item asks for tokens, one segment, and loss-bearing tokens; each sequence offers `length` tokens, `segments`
segments and `loss` loss-bearing tokens. A sequence is filled from a pool of waiting items: of those that fit, the
one with the greatest dot product of its demand and what the sequence has left, both as shares of the limits,
goes in. When none fits, an item is cut to fill the rest. An item longer than a sequence fills whole
sequences first. What a task has left at its end goes into sequences of powers of two, so nothing is padded there.

Each task packs the rows it reads: there is no shuffle, memory is the pool, a run of texts and one text, and a task that
is run again gives the same sequences.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, SEGMENTS, POOL = 4096, 1024, 1024
#: Instruction data: pieces and loss-bearing tokens of a sequence.
ANSWERS, ANSWER_LOSS = 64, 3072
#: Bytes of text that are encoded together.
RUN = 1 << 22
#: Sequences of one task are numbered from its partition's number times this.
STRIDE = 1 << 36


@dataclass
class Item:
    """tokens start..start+length of an example, of which those from `loss_from` on bear loss."""

    owner: object
    start: int
    length: int
    loss_from: int = 0

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.loss_from))

    def cut(self, at: int) -> tuple[Item, Item]:
        return Item(self.owner, self.start, at, self.loss_from), Item(self.owner, self.start + at, self.length - at, self.loss_from)


@dataclass
class Packer:
    """add() items, then finish(); each gives closed sequences, as lists of items in order."""

    length: int = LENGTH
    segments: int = SEGMENTS
    loss: int = LENGTH
    pool_size: int = POOL

    def __post_init__(self) -> None:
        if min(self.length, self.segments, self.loss, self.pool_size) < 1 or self.length & (self.length - 1):
            raise ValueError("limits must be positive, and the length a power of two")
        self.pool: list[Item] = []
        #: Of each waiting item: tokens, segments and loss-bearing tokens it asks for, and tokens before the first that bears loss.
        self.asks = np.zeros((self.pool_size + 2, 4))
        self.scale = np.array([self.length, self.segments, self.loss], float) ** 2
        self.tokens = 0

    def add(self, item: Item):
        while item.length >= self.length:
            whole, rest = item.cut(self.length)
            if whole.loss > self.loss:
                break
            yield [whole]
            item = rest
        if item.length:
            self._wait(item)
        while len(self.pool) > self.pool_size or self.tokens > self.pool_size * self.length:
            yield self._next(self.length)

    def finish(self):
        while self.tokens:
            yield self._next(min(self.length, 1 << (self.tokens.bit_length() - 1)))

    def _wait(self, item: Item) -> None:
        if len(self.pool) == len(self.asks):
            self.asks = np.concatenate([self.asks, np.zeros_like(self.asks)])
        self.asks[len(self.pool)] = item.length, 1, item.loss, max(0, item.loss_from - item.start)
        self.pool.append(item)
        self.tokens += item.length

    def _take(self, k: int) -> Item:
        item, last = self.pool[k], self.pool.pop()
        if last is not item:
            self.pool[k], self.asks[k] = last, self.asks[len(self.pool)]
        self.tokens -= item.length
        return item

    def _next(self, room: int) -> list[Item]:
        """One sequence of exactly `room` tokens, or of a smaller power of two where another limit binds."""
        left, out = np.array([room, self.segments, self.loss], float), []
        while self.pool and left[0] > 0 and left[1] > 0:
            asks = self.asks[: len(self.pool)]
            worth = np.where((asks[:, :3] <= left).all(1), asks[:, :3] @ (left / self.scale), -1)
            best = int(worth.argmax())
            if worth[best] >= 0:
                item = self._take(best)
            else:  # the longest head that fits, of the shortest of the items that have it
                heads = np.minimum(np.minimum(asks[:, 0], left[0]), asks[:, 3] + left[2])
                if heads.max() < 1:
                    break
                best = int(np.lexsort((asks[:, 0], -heads))[0])
                item, tail = self._take(best).cut(int(heads[best]))
                self._wait(tail)
            out.append(item)
            left -= (item.length, 1, item.loss)
        size = sum(i.length for i in out)
        keep = 1 << (size.bit_length() - 1)
        while size > keep:
            item = out.pop()
            size -= item.length
            if size < keep:
                head, item = item.cut(keep - size)
                out.append(head)
                size = keep
            self._wait(item)
        return out


class PairTable:
    """A number for each of some pairs of symbols, NONE for the others: two array look-ups a pair.

    The place of a pair is its key times a factor of its bucket; factors are drawn until no two pairs share a place.
    """

    NONE = (1 << 16) - 1

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        if len(np.unique(keys)) < len(keys):
            raise ValueError("a pair is merged in one way only")
        bits = max(8, len(keys).bit_length() + 1)
        self.shift, self.bucket_shift = np.uint32(32 - bits), np.uint32(34 - bits)
        self.keys, self.numbers = np.zeros(1 << bits, np.uint32), np.full(1 << bits, self.NONE, np.uint16)
        self.factors = np.ones(1 << (bits - 2), np.uint32)
        bucket = self._bucket(keys)
        order = np.argsort(-np.bincount(bucket)[bucket], kind="stable")
        keys, numbers, bucket = keys[order], numbers[order], bucket[order]
        draws, taken = np.random.default_rng(0), np.zeros(1 << bits, bool)
        while len(keys):
            self.factors[bucket] = factor = np.uint32(draws.integers(1 << 31) * 2 + 1)
            at = keys * factor >> self.shift
            clash = np.ones(len(at), bool)
            clash[np.unique(at, return_index=True)[1]] = False
            failed = np.zeros(len(self.factors), bool)
            failed[bucket[clash | taken[at]]] = True
            again = failed[bucket]
            at = at[~again]
            taken[at], self.keys[at], self.numbers[at] = True, keys[~again], numbers[~again]
            keys, numbers, bucket = keys[again], numbers[again], bucket[again]

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint32(0x9E3779B1) >> self.bucket_shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys * self.factors.take(self._bucket(keys)) >> self.shift
        return np.where(self.keys.take(at) == keys, self.numbers.take(at), np.uint16(self.NONE))


class Merges:
    """Pair merging of many words at once, for a vocabulary file with byte-level symbols and an end-of-word suffix.

    A column of symbols, links to the symbols before and after, and the ranks of the pairs stand for each word. Every round merges each
    word's pair of the lowest rank, leftmost first, so a round is a few array operations however many words there are.
    """

    #: Bytes of a word at most: a rank and a place are one number, the place in its lowest bits.
    LONGEST, PLACE = 48, 6

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        shown = _byte_symbols()
        if max(max(vocab.values()), len(merges)) >= PairTable.NONE:
            raise ValueError("a pair of ids must fit in 32 bits, and a rank in 16")
        self.bytes = np.array([vocab[c] for c in shown], np.uint16)
        self.last = np.array([vocab[c + end] for c in shown], np.uint16)
        self.rank = PairTable(np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint32), np.arange(len(merges), dtype=np.uint16))
        self.made = np.array([vocab[a + b] for a, b in merges], np.uint16)

    def ids(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
        """The packed ids of each word: size bytes of raw from start on, at least one and at most LONGEST."""
        order = np.argsort(size, kind="stable")
        found = [self._merge(raw, start[some], size[some]) for at in range(0, len(order), 4096) for some in [order[at : at + 4096]]]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return _binary(np.concatenate([i for i, _ in found] or [[]]), np.concatenate([n for _, n in found] or [[]])).take(pa.array(place))

    def _merge(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words sorted by size, one word after the other, and the number of ids of each."""
        words, longest = len(size), int(size[-1])
        none, low = np.uint32(PairTable.NONE << self.PLACE), np.uint32((1 << self.PLACE) - 1)
        ids = np.full((longest + 1, words), PairTable.NONE, np.uint16)  # the last row belongs to no word
        for k in range(longest):
            more = np.searchsorted(size, k, "right")
            ids[k, more:] = self.bytes[raw[start[more:] + k]]
        ids[size - 1, np.arange(words)] = self.last[raw[start + size - 1]]
        live = ids != PairTable.NONE
        column = np.arange(longest + 1, dtype=np.uint32).repeat(words)
        ranks = np.full(ids.shape, none, np.uint32)
        ranks[:-1] = self._key(ids[:-1], ids[1:], column[:-words].reshape(longest, words))
        after = np.arange(words, words * (longest + 2))
        before = after - 2 * words
        before[:words] += words * (longest + 1)
        flat, ranked, lives = ids.reshape(-1), ranks.reshape(-1), live.reshape(-1)
        while True:
            best = ranks.min(0)
            word = np.flatnonzero(best < none)
            if not len(word):
                return ids.T[live.T], live.sum(0)
            best = best[word]
            at = (best & low) * words + word
            gone, left = after.take(at), before.take(at)
            right = after.take(gone)
            new = self.made.take(best >> self.PLACE)
            flat[at], after[at], before[right] = new, right, at
            lives[gone], ranked[gone] = False, none
            first, second = np.concatenate([flat.take(left), new]), np.concatenate([new, flat.take(right)])
            where = np.concatenate([left, at])
            ranked[where] = self._key(first, second, column.take(where))

    def _key(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The rank of a pair, with its place behind; without a rank it isn't less than none."""
        return self.rank(left.astype(np.uint32) << np.uint32(16) | right).astype(np.uint32) << np.uint32(self.PLACE) | place


def _binary(ids: np.ndarray, size: np.ndarray) -> pa.Array:
    """Packed ids as an array of binaries, size[k] ids in the k-th."""
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64) * 4]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is printable in Latin-1, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


OTHER, LETTER, DIGIT, SPACE = range(4)


def _latin1() -> tuple[np.ndarray, np.ndarray]:
    """For the last byte of each Latin-1 character in UTF-8, plus 256 after byte C2 and 512 after C3: the byte of its lower case, and its class to the tokeniser."""
    lower, kind = np.arange(768) % 256, np.full(768, OTHER)
    for c in map(chr, range(256)):
        lead, byte = [0, *c.encode()][-2:]
        at = byte + {0: 0, 0xC2: 256, 0xC3: 512}[lead]
        lower[at] = c.lower().encode()[-1]
        kind[at] = SPACE if c in "\t\n\v\f\r \x85\xa0" else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(c)[0], OTHER)
    return lower.astype(np.uint8), kind.astype(np.uint8)


LOWER, KIND = _latin1()


class WordIds:
    """The packed ids of texts. The tokeniser works on words between white space apart, so a run's texts share each word's ids.

    Words in Latin-1 are lower-cased and cut into pieces here: runs of letters, single digits, runs of other characters. Merges
    takes the different pieces of all of them together. The tokeniser itself encodes other words, those with an apostrophe, which may
    begin a piece of its own, and long pieces. Of what it encoded, two generations of `most` words or `most_bytes` bytes each
    are kept: those that are met again move to the younger.
    """

    def __init__(self, path: str, most: int = 400_000, most_bytes: int = 50_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.merges, self.most, self.most_bytes = Tokenizer.from_file(path), Merges(path), most, most_bytes
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def ids(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts.validate(full=True)  # else bytes that aren't UTF-8 would pass for characters
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = cut.flatten().dictionary_encode()
        found = self._words(words.dictionary).take(words.indices)
        ends = _ends(found)[np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())]).astype(np.int64)].tolist()
        data = memoryview(found.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in pairwise(ends)]

    def _words(self, words: pa.Array) -> pa.Array:
        """The packed ids of different words without ASCII white space."""
        ends, raw = _ends(words), np.frombuffer(words.buffers()[2] or b"", np.uint8)
        raw = raw[: ends[-1]]
        hard = np.zeros(len(words), bool)
        hard[np.searchsorted(ends, np.flatnonzero((raw >= 0xC4) | (raw == ord("'"))), "right") - 1] = True
        word = np.arange(len(words), dtype=np.int32).repeat(np.diff(ends))
        # classes of bytes: a lead byte has that of its character
        lead = np.flatnonzero((raw == 0xC2) | (raw == 0xC3))
        coded = raw.astype(np.int16)
        coded[lead + 1] += np.int16(256) * (raw[lead] - np.int16(0xC1))
        kind, lower = KIND.take(coded), LOWER.take(coded)
        kind[lead] = kind[lead + 1]
        first = np.ones(len(raw), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (word[1:] != word[:-1])
        first[lead + 1] = False
        kept = (kind != SPACE) & ~hard[word]
        first, lower, word = first[kept], lower[kept], word[kept]
        starts = np.flatnonzero(first)
        bounds = np.append(starts, len(lower)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(lower)]).dictionary_encode()
        made = self._pieces(pieces.dictionary).take(pieces.indices)
        # a word's ids are those of its pieces, which stand together
        before = np.searchsorted(word[starts], np.arange(len(words) + 1, dtype=np.int32))
        plain = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(_ends(made)[before]), made.buffers()[2] or pa.py_buffer(b"")])
        if not hard.any():
            return plain
        which = np.arange(len(words))
        which[hard] = len(words) + np.arange(hard.sum())
        other = pa.array(self._encoded(words.filter(pa.array(hard)).cast(pa.large_binary()).to_pylist()), pa.large_binary())
        return pa.concat_arrays([plain, other]).take(pa.array(which))

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """The packed ids of different pieces in lower case."""
        ends, raw = _ends(pieces), np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        size = np.diff(ends)
        long = size > self.merges.LONGEST
        short = np.flatnonzero(~long)
        made = self.merges.ids(raw, ends[short], size[short])
        if not long.any():
            return made
        which = np.empty(len(pieces), np.int64)
        which[short], which[long] = np.arange(len(short)), len(short) + np.arange(long.sum())
        other = pa.array(self._encoded(pieces.filter(pa.array(long)).to_pylist()), pa.large_binary())
        return pa.concat_arrays([made, other]).take(pa.array(which))

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of words by the tokeniser itself."""
        out = {w: ids for w in words if (ids := self.young.get(w)) is not None}
        more = {w: ids for w in words if w not in out and (ids := self.old.get(w)) is not None}
        fresh = [w for w in words if w not in out and w not in more]
        for at in range(0, len(fresh), 1024):
            some = fresh[at : at + 1024]
            encoded = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            more |= {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(some, encoded, strict=True)}
        out |= more
        self.young |= more
        self.held += sum(len(w) + len(ids) for w, ids in more.items())
        if len(self.young) > self.most or self.held > self.most_bytes:
            self.old, self.young, self.held = self.young, {}, 0
        return [out[w] for w in words]


def _ends(values: pa.Array) -> np.ndarray:
    """Where each value of a large string or binary array without nulls begins, and where the last ends."""
    return np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _runs(batch: pa.RecordBatch):
    """The rows of a batch in runs of about RUN bytes of text."""
    held = np.cumsum(sum(pc.binary_length(batch.column(c)).fill_null(0).to_numpy().astype(np.int64) for c in ("text", "prompt")))
    cuts = [0, *(np.flatnonzero(np.diff(held // RUN)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in pairwise(cuts))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def packed_documents(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, pool_size: int = POOL, with_ids: bool = False, prompt: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) for each piece of each row of docs.

    prompt: a column of texts that come before `text`, are packed with it and bear no loss (null: none); without it every
    token of a document bears loss. At most `loss` loss-bearing tokens and `segments` pieces go into a sequence. Null counts as empty; an empty text is its end id alone. Each
    id of a row is in exactly one piece, rows that repeat are packed each; a row without doc_id keeps null.
    Columns besides doc_id and text aren't read. An empty table gives an empty result.
    """

    def run(batches):
        words, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        packer, number, rows = Packer(length, segments, length if loss is None else loss, pool_size), TaskContext.get().partitionId() * STRIDE, []

        def written(sequence: list[Item]) -> None:
            nonlocal number
            at = 0
            for item in sequence:
                doc, ids = item.owner
                piece = ids[4 * item.start : 4 * (item.start + item.length)]
                rows.append((doc, item.start, item.length, zlib.crc32(piece), len(ids) // 4, number, at, piece if with_ids else None))
                at += item.length
            number += 1

        def flushed() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows, strict=True)] or [()] * 8, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
            rows.clear()
            return out

        for batch in batches:
            for some in _runs(batch):
                heads = [b""] * some.num_rows if prompt is None else words.ids(some.column("prompt"))
                for doc, head, ids in zip(some.column("doc_id").to_pylist(), heads, words.ids(some.column("text")), strict=True):
                    ids = head + ids + end
                    for sequence in packer.add(Item((doc, ids), 0, len(ids) // 4, len(head) // 4)):
                        written(sequence)
                if len(rows) >= 5000:
                    yield flushed()
        for sequence in packer.finish():
            written(sequence)
        yield flushed()

    before = F.lit(None) if prompt is None else F.col(prompt)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), before.cast("string").alias("prompt"))
    out = chosen.mapInArrow(run, PIECES)
    return out if with_ids else out.drop("ids")


def packed_answers(conversations: DataFrame, path: str, segments: int = ANSWERS, loss: int = ANSWER_LOSS, **options) -> DataFrame:
    """packed_documents() of instruction data: each assistant turn is an example that bears loss, after the turn before it as its prompt.

    conversations: conv_id, turn, role, text, a row for each turn; doc_id of the pieces is conv_id * 1024 + the turn's place. A sequence
    holds at most `segments` pieces and `loss` loss-bearing tokens. Null texts are empty; a conversation without assistant gives nothing.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    talks = conversations.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.posexplode("turns").alias("at", "t"), "turns")
    rows = talks.filter(F.col("t.role") == "assistant").select((F.col("conv_id") * 1024 + F.col("at")).alias("doc_id"), F.col("t.text").alias("text"), F.get("turns", F.col("at") - 1)["text"].alias("prompt"))
    return packed_documents(rows, path, segments=segments, loss=loss, prompt="prompt", **options)
