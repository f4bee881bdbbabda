"""Language-model scores: exact base counts, the filter's levels, and held-out likelihood."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm.lm_scoring import Filter, Words, bigrams, build_filter, lm_scores, split, unigrams, words_of

SCHEMA = "doc_id long, text string, n long, token string"


def corpus():
    rng = random.Random(1)
    words = [f"{c}{i}" for c in ("Alpha", "beta", "é") for i in range(40)]
    follow = {w: rng.sample(words, 3) for w in words}
    rows = []
    for i in range(300):
        w, out = rng.choice(words), []
        for _ in range(rng.choice([1, 20, 80])):
            out.append(w)
            w = rng.choice(follow[w]) if rng.random() < 0.8 else f"rare{rng.randrange(5000)}"
            follow.setdefault(w, words)
        rows.append((i, " ".join(out), 1, "x"))
    return rows + [(1000, None, 1, "x"), (1001, "", 1, "x"), (1002, " \n\t", 1, "x"), (1003, "same", 1, "x"), (1003, "same", 1, "x"), (None, "no id", 1, "x"), (1004, "Long\x0bword " * 60_000, 1, "x")]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize("head", [50, 100_000])
def test_base_is_exact(spark, head):
    rows = corpus()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = lm_scores(spark.createDataFrame(rows, SCHEMA), head=head).collect()
    key = lambda r: (str(r[0]), *map(int, r[1:5]))
    want, base = [], {}
    for i, t, *_ in rows:
        ws = tokens(t)
        want.append(key((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n)))
        base[i] = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
    assert sorted(key(r) for r in got) == sorted(want)
    assert all(math.isclose(r.base_score, base[r.doc_id], rel_tol=1e-9, abs_tol=1e-9) for r in got)
    out = [r for r in got if r.held_out and r.n_tokens > 5]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(-1e9 < r.score < 0 for r in got)


def test_levels(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    known, c = Words(), Counter()
    for _, t, *_ in rows:
        words = known.hashed([words_of(t)])
        c.update(unigrams(words[1:]).tolist())
        c.update(bigrams(words).tolist())
    table, least = build_filter(docs, 200_000)
    assert least == 1
    keys = np.array([*c], np.uint64)
    want = 1 + np.floor(np.log2([*c.values()])).astype(int)
    got = table.levels(keys)
    assert (got >= want).all() and (got > want).mean() < 0.03
    absent = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert (table.levels(absent) > 0).mean() < 0.03
    small, least = build_filter(docs, 200_000, most_bits=1 << 15)
    assert least > 1 and small.bits.size * 8 <= 1 << 15
    assert (small.levels(keys)[want >= least] >= (want - least + 1)[want >= least]).all()
    assert Filter.counts(np.arange(5)).tolist() == [0, 1, 2.5, 5.5, 11.5] and split(np.array([1 << 63], np.uint64), 8)[0][0] == 128


def test_no_training_and_empty(spark):
    lone = next(i for i in range(100) if held(i))
    r = lm_scores(spark.createDataFrame([(lone, "a b", 1, "x")], SCHEMA)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and abs(r.base_score) < 1e-12
    assert lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_rest_on_every_ngram(spark):
    """Whatever the chunks and ranges, a score is that of the exact levels of all n-grams, but for the filter's false positives."""
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    texts = {i: [*words_of(t), b" "] for i, t, *_ in rows}
    ones, pairs = Counter(), Counter()
    for i, t, *_ in rows:
        if not held(i):
            words = [*words_of(t), b" "]
            ones.update(words)
            pairs.update(zip([b" ", *words], words))
    small, large = ({(str(r.doc_id), r.n_tokens): r.score for r in lm_scores(docs, chunk=c, span=s).collect()} for c, s in ((500, 100), (10**6, 1 << 20)))
    assert small.keys() == large.keys()
    level = lambda c: np.floor(np.log2(np.maximum(c, 1))).astype(int) + (np.asarray(c) > 0)
    expected = lambda c: Filter.counts(level(np.array(c)))
    n, v = sum(ones.values()), len(ones)

    def parts(words):
        before = [b" ", *words][:-1]
        return expected([ones[w] for w in words]), expected([ones[w] for w in before]), level(np.array([ones[w] for w in before])), expected([pairs[x] for x in zip(before, words)])

    votes = np.zeros((2, 64))
    for i, t, *_ in rows:
        if not held(i):
            one, before, at, both = parts([*words_of(t), b" "])
            pair = np.where(before > 1, np.minimum(1.0, np.maximum(both - 1, 0) / np.maximum(before - 1, 1)), 0.0)
            better = pair > np.maximum(one - 1, 0.1) / n
            votes += [np.bincount(at[better], minlength=64), np.bincount(at[~better], minlength=64)]
    weights = votes[0] / (votes.sum(0) + 10)
    off = []
    for i, words in texts.items():
        one, before, at, both = parts(words)
        want = np.log10(weights[at] * np.minimum(1.0, both / np.maximum(before, 1)) + (1 - weights[at]) * (one + 0.1) / (n + 0.1 * (v + 1))).sum()
        off += [abs(got[str(i), len(words)] - want) / len(words) for got in (small, large)]
    assert np.mean(off) < 0.02


def test_weights_rest_on_all_texts(spark):
    """A context level that one training text alone shows, whatever its hash, gets its weight."""
    ids = [r[0] for r in spark.range(6000, 6200).filter("pmod(xxhash64(id), 1048576) > 1000000").collect()]
    lone = next(i for i in ids if not held(i))
    rows = [(i, f"only{i}", 1, "x") for i in range(6000)] + [(lone, "left right " * 100, 1, "x")]
    got = {r.doc_id: r for r in lm_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[lone].score / got[lone].n_tokens > -0.5
