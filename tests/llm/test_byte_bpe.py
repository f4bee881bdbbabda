"""Byte-level BPE against the library, and the scan against the pattern."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm.byte_bpe import code_point_classes, encoded, encoding_digest, loaded, symbols, token_starts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
BITS = ["'", "s", "'ll", "'re", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "٣", ".", "-", " ", " ", "漢字", "🙂", "́", "'Ve", "'ve", "\x1c", "\x85", "\0", "don't", "x" * 70]


def library_ids(text):
    return np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_boundaries_are_those_of_the_pattern():
    rng, classes = random.Random(1), code_point_classes()
    for _ in range(300):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(0, 200)))
        points = np.array([*map(ord, text), 0], "<u4")
        got = token_starts(symbols(points, np.array([len(text)]), classes)).tolist()
        assert got == [*(m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)), len(text)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_ids_are_the_library_s(texts):
    coder = loaded(PATH)
    got = coder.encode(texts) if texts else []
    assert got == [library_ids(t) for t in texts]
    assert [coder.decode(p) for p in got] == [t.encode() for t in texts]


def test_long_pieces_and_offsets():
    coder, text = loaded(PATH), "ab" * 20_000 + " " + "é" * 3000 + "!" * 5000
    packed = coder.encode([text])[0]
    assert packed == library_ids(text)
    at = coder.offsets(packed)
    assert at[-1] == len(text.encode()) and b"".join(text.encode()[a:b] for a, b in zip(at, at[1:])) == text.encode()


def test_table(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(60)), 1) for i in range(50)] + [(7, None, 2), (7, "", 3), (None, "x y", 4), (8, "word " * 300_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoding_digest(docs, PATH).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((str(i), len(library_ids(t or "")) // 4, sha(library_ids(t or "")), sha((t or "").encode())) for i, t, _ in rows)
    assert sorted(bytes(r.decoded) for r in encoded(docs.filter("doc_id <> 8"), PATH).collect()) == sorted((t or "").encode() for i, t, _ in rows if i not in (8, None))
    assert encoding_digest(docs.limit(0), PATH).count() == 0
