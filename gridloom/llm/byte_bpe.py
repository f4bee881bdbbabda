"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Each code point has a class from an array; with what follows it, the class makes a symbol, and each symbol is a
transition function on the few states of the pre-tokeniser. Composition of functions is associative, so boundaries
come from a scan: blocks of symbols are composed side by side, the blocks' functions are scanned, and each
block is then run from its own entry state. No regular expression is run over the text. The slices between boundaries feed
pair merging through a cache, and the offsets of the tokens' bytes are kept for decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols: letter, number, other, a space or other white space before something else, white space before white space or the end, an apostrophe before a suffix of one or two letters, the end of a text.
LETTER, NUMBER, OTHER, SPACE, BLANK, MORE, ONE, TWO, END = range(9)
#: States: what is open before a symbol. Nothing; a run of letters, numbers, others, white space; a space that will join what follows; a suffix with one or two letters to come.
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, JOINING, SUFFIX1, SUFFIX2 = range(8)
STATES = 8
BLOCK, PART = 64, 1 << 20


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """The next state, and whether a token begins, by symbol * STATES + state."""
    after, begins = np.zeros((9, STATES), np.uint8), np.ones((9, STATES), np.bool_)
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        after[symbol] = run
        begins[symbol, [run, JOINING]] = False
    after[LETTER, SUFFIX1], after[LETTER, SUFFIX2] = NONE, SUFFIX1
    begins[LETTER, [SUFFIX1, SUFFIX2]] = False
    for symbol, suffix in ((ONE, SUFFIX1), (TWO, SUFFIX2)):
        after[symbol] = suffix
        after[symbol, [IN_OTHERS, JOINING]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, JOINING]] = False
    after[SPACE], after[BLANK], after[MORE], after[END] = JOINING, NONE, IN_BLANKS, NONE
    begins[MORE, IN_BLANKS] = False
    return after.ravel(), begins.ravel()


AFTER, BEGINS = _machine()


def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, SPACE or BLANK by code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for m in regex.finditer(pattern, every):
            classes[[ord(c) for c in m[0]]] = kind
    classes[ord(" ")] = SPACE
    return classes


def symbols(points: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """points: code points of texts, one more at the place of each text's end (ends)."""
    kind = classes[points]
    kind[ends] = END
    after = np.append(kind[1:], END)
    out = kind.copy()
    out[(kind >= SPACE) & (kind <= BLANK) & (after >= SPACE)] = MORE
    at = np.flatnonzero((points == ord("'")) & (kind == OTHER))
    if at.size:
        padded = np.append(points, [0, 0])
        first, second = padded[at + 1], padded[at + 2]
        out[at[np.isin(first, [ord(c) for c in "stmd"]) & (kind[np.minimum(at + 1, kind.size - 1)] == LETTER)]] = ONE
        inside = kind[np.minimum(at + 2, kind.size - 1)] == LETTER
        for a, b in ("re", "ve", "ll"):
            out[at[(first == ord(a)) & (second == ord(b)) & inside]] = TWO
    return out


def _entries(functions: np.ndarray) -> np.ndarray:
    """Exclusive scan: the state in which each function is entered, the first in NONE."""
    n = len(functions)
    if n <= BLOCK:
        state, out = NONE, np.empty(n, np.uint8)
        for i, f in enumerate(functions):
            out[i], state = state, f[state]
        return out
    rows = -(-n // BLOCK)
    identity = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows * BLOCK - n, STATES))
    grid = np.concatenate([functions, identity]).reshape(rows, BLOCK, STATES)
    whole = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES))
    for k in range(BLOCK):
        whole = np.take_along_axis(grid[:, k], whole.astype(np.intp), 1)
    state, out = _entries(whole), np.empty((rows, BLOCK), np.uint8)
    for k in range(BLOCK):
        out[:, k] = state
        state = np.take_along_axis(grid[:, k], state[:, None].astype(np.intp), 1)[:, 0]
    return out.ravel()[:n]


def token_starts(symbol: np.ndarray) -> np.ndarray:
    """Places at which a token begins; the last symbol is an END."""
    n = symbol.size
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, END, np.intp)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T) * STATES
    function = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES))
    for step in grid:
        function = AFTER[step[:, None] + function]
    state, begins = _entries(function), np.empty((BLOCK, rows), np.bool_)
    for k, step in enumerate(grid):
        at = step + state
        begins[k], state = BEGINS[at], AFTER[at]
    return np.flatnonzero(begins.T.ravel()[:n])


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the adjacent pair of the lowest rank, leftmost first, until none is left. A heap holds the pairs, so a long piece takes n log n steps."""
    n = len(piece)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ends[i]
        if not alive[i] or j >= n or ends[j] != end:
            continue
        ends[i], alive[j] = end, False
        if end < n:
            before[end] = i
            if (rank := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (rank, i, ends[end]))
        if (h := before[i]) >= 0 and (rank := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (rank, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class _Cache(dict):
    """The packed ids of a piece; emptied when it has grown to `most` pieces."""

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000, longest: int = 64):
        super().__init__()
        self.ranks, self.most, self.longest = ranks, most, longest

    def __missing__(self, piece: bytes) -> bytes:
        rank = self.ranks.get(piece)
        ids = [rank] if rank is not None else merge_pairs(piece, self.ranks)
        packed = np.array(ids, "<u4").tobytes()
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = packed
        return packed


class ByteBPE:
    """encode() and decode() for the rank file at path (lines of base64 bytes and rank). Empty pieces don't occur; an empty text has no ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.cache, self.classes = _Cache(ranks), code_point_classes()
        self.pieces = dict(zip(ranks.values(), ranks.keys(), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        whole = "\0".join(texts) + "\0"
        points, raw = np.frombuffer(whole.encode("utf-32-le"), "<u4"), whole.encode("utf-8")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        starts = token_starts(symbols(points, ends, self.classes))
        width = np.ones(points.size, np.int64)
        for limit in (0x80, 0x800, 0x10000):
            width += points >= limit
        places = np.concatenate([[0], np.cumsum(width)])[starts].tolist()
        packed = [*map(self.cache.__getitem__, [raw[a:b] for a, b in zip(places, places[1:])])]  # noqa: B905  the last is an end
        last = np.searchsorted(starts, ends).tolist()
        first = [0, *[x + 1 for x in last[:-1]]]
        return [b"".join(packed[a:b]) for a, b in zip(first, last, strict=True)]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def offsets(self, packed: bytes) -> np.ndarray:
        """Where each token's bytes begin in the decoded text, and where the last ends."""
        sizes = [len(self.pieces[i]) for i in np.frombuffer(packed, "<u4").tolist()]
        return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


_loaded: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """One encoder for each worker and rank file."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def parts(texts: list[str], most: int = PART):
    """Runs of texts with at most so many code points together, a longer text alone."""
    at = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield texts[at:i]
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield texts[at:]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (packed), decoded (bytes), offsets (of each token's bytes) of each row. path: the rank file, readable on every worker."""

    def run(batches):
        coder = loaded(path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [x or "" for x in batch.column("text").to_pylist()]
            for some in parts(texts):
                here, ids = ids[: len(some)], ids[len(some) :]
                packed = coder.encode(some)
                yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(packed, pa.binary()), pa.array([coder.decode(p) for p in packed], pa.binary()), pa.array([coder.offsets(p) for p in packed], pa.list_(pa.int64()))], ["doc_id", "ids", "decoded", "offsets"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids binary, decoded binary, offsets array<long>")


def encoding_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encoded() gives, as digests.

    Null and empty texts have no ids. Rows that repeat are all returned; columns besides doc_id and text
    aren't read; an empty table gives an empty result. A text is held in memory as a whole, and nothing else is.
    """

    def run(batches):
        coder = loaded(path)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            ids, texts, rows = batch.column("doc_id"), [x or "" for x in batch.column("text").to_pylist()], []
            for some in parts(texts):
                rows += [(len(p) // 4, digest(p), digest(coder.decode(p))) for p in coder.encode(some)]
            columns = [*zip(*rows, strict=True)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
