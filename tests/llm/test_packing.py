"""Packing: every token once, every limit kept, the tokeniser's own ids."""

import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm.packing import RUN, Item, Packer, WordIds, _runs, packed_answers, packed_documents, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def packed(items, **limits):
    packer, out = Packer(**limits), []
    for item in items:
        out += packer.add(item)
    return out + [*packer.finish()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.floats(0, 1)), max_size=60), st.sampled_from([16, 32]), st.integers(1, 9), st.integers(1, 32), st.integers(1, 20))
def test_limits_and_coverage(examples, length, segments, loss, pool):
    items = [Item(i, 0, n, int(n * share)) for i, (n, share) in enumerate(examples)]
    sequences = packed(items, length=length, segments=segments, loss=loss, pool_size=pool)
    seen = defaultdict(list)
    for s in sequences:
        size = sum(i.length for i in s)
        assert 0 < size <= length and size & (size - 1) == 0
        assert len(s) <= segments and sum(i.loss for i in s) <= loss
        for i in s:
            seen[i.owner].append((i.start, i.length))
    for i, (n, _) in enumerate(examples):
        at = 0
        for start, size in sorted(seen[i]):
            assert start == at
            at += size
        assert at == n


def test_prefers_the_item_along_what_is_left():
    first = packed([Item("long", 0, 12), Item("short", 0, 3), Item("mid", 0, 4)], length=16, segments=4, loss=16)[0]
    assert [i.owner for i in first] == ["long", "mid"]


def test_documents(spark):
    rng = random.Random(3)
    bits = ["Hello", "é", "ÉCOLE's", "don't", "42x7", "漢字", "🙂", "İ", " ", "\x1c", " ", "\n", " ", " ", "<|endoftext|>", "a" * 300, "ΑΣ", "é"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 50, 400]))), 1) for i in range(120)]
    rows += [(500, None, 2), (501, "", 3), (None, "no id", 4), (502, "word " * 20_000, 5)] + [(600 + i, "", 6) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    got = packed_documents(docs, PATH, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length * 4 == len(r.ids)
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == np.array(ids, "<u4").tobytes()
        assert {r.doc_tokens for r in mine} == {len(ids)} and [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s])[:-1]]
        size = sum(r.length for r in s)
        assert size <= 4096 and size & (size - 1) == 0
    assert packed_documents(docs.limit(0), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.text("aeiouthrnsél.,!ÀÿßµªºÅ#$ \n'19", max_size=60)), max_size=30))
def test_ids_are_the_tokeniser_s(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    words = word_ids(PATH)
    assert words.ids(texts) == want and words.ids(texts) == want


def test_ids_of_every_latin1_character_and_of_long_and_odd_words():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    latin = [chr(c) for c in range(256)]
    texts = [t for c in latin for t in (c, f"A{c}b", f"{c}É{c}{c}9", f"7{c}", f"'{c}s!{c}'LL")] + ["".join(latin), "".join(random.Random(c).choices(latin, k=300)[0] for c in range(2000))]
    texts += [x * n for x in ("a", "É", "#", "7", "a.", "ß'", "字") for n in range(1, 60)] + ["", " ", "\x85", "\xa0\xa0", "'", "İJ\u030c j\u030c", "e\u0301 E\u0301", "b" * 5000, "=" * 5000 + "é"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    words = WordIds(PATH, most=50, most_bytes=10_000)
    assert words.ids(texts) == want and [i for t in texts for i in words.ids([t])] == want
    odd = pa.array([None, *texts, None], pa.string())
    assert words.ids(odd.slice(1, len(texts))) == want and words.ids(odd)[::len(odd) - 1] == [b"", b""] and words.ids([]) == []
    assert words.held <= 10_000 and len(words.young) <= 50
    for broken in (b"a\xc3 b", b"\xc3", b"a\xffb"):
        with pytest.raises(pa.ArrowInvalid):
            words.ids(pa.array([broken]).view(pa.string()))


def test_ids_cost_little_more_than_cutting_the_texts():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").combine_chunks()[:5000]
    plain = [t or "" for t in texts.to_pylist()]
    piece = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")

    def least(run, made):
        seconds = []
        for _ in range(3):
            given, began = made(), time.process_time()
            run(given)
            seconds.append(time.process_time() - began)
        return min(seconds)

    cut = least(lambda _: [piece.findall(t.lower()) for t in plain], lambda: None)
    encoded = least(lambda words: [words.ids(plain[at : at + 1000]) for at in range(0, len(plain), 1000)], lambda: WordIds(PATH))
    assert encoded < 2.5 * cut


def test_runs_of_a_batch():
    texts = ["a" * n for n in (0, 5, RUN, 3, 2 * RUN, 1, 1)] + [None] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts), pa.array([None] * 10, pa.string())], ["doc_id", "text", "prompt"])
    runs = [r.column("doc_id").to_pylist() for r in _runs(batch)]
    assert sum(runs, []) == [*range(10)] and len(runs) > 1 and all(runs)
    assert all(sum(len(texts[i] or "") for i in r[1:]) < RUN for r in runs)
    assert [r.num_rows for r in _runs(batch.slice(0, 0))] == [0]


def first_fit(items, length, segments, loss):
    """Sequences opened by taking each item, cut at the length and the loss, into the first that has room."""
    bins = []
    for item in items:
        while item.length:
            head, tail = item.cut(min(item.length, length, max(0, item.loss_from - item.start) + loss))
            for b in bins:
                if b[0] + head.length <= length and b[1] < segments and b[2] + head.loss <= loss:
                    break
            else:
                bins.append(b := [0, 0, 0])
            b[0], b[1], b[2], item = b[0] + head.length, b[1] + 1, b[2] + head.loss, tail
    return len(bins)


def test_all_limits_bind_on_instruction_data(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    limits = {"length": 256, "segments": 6, "loss": 128}
    got = packed_answers(conversations, PATH, with_ids=True, **limits).collect()
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    count = lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)
    talks = defaultdict(list)
    for r in sorted(conversations.collect(), key=lambda r: (r.conv_id, r.turn, r.role or "", r.text or "")):
        talks[r.conv_id].append(r)
    heads = {c * 1024 + k: (count(t[k - 1].text) if k else 0, count(t[k].text) + 1) for c, t in talks.items() for k in range(len(t)) if t[k].role == "assistant"}
    sequences, held = defaultdict(list), defaultdict(int)
    for r in got:
        head, own = heads[r.doc_id]
        assert r.doc_tokens == head + own
        held[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.length, max(0, r.start + r.length - max(r.start, head))))
    assert held == {i: sum(n) for i, n in heads.items()}
    sizes = [(sum(n for n, _ in s), len(s), sum(x for _, x in s)) for s in sequences.values()]
    assert all(n <= 256 and k <= 6 and x <= 128 for n, k, x in sizes)
    assert any(k == 6 for _, k, _ in sizes) or any(x == 128 and n < 256 for n, _, x in sizes)
    padding = sum((256 if n & (n - 1) else n) - n for n, *_ in sizes)
    assert padding == 0 and len(sequences) < 2 * first_fit([Item(i, 0, sum(n), n[0]) for i, n in heads.items()], **limits) + 20
