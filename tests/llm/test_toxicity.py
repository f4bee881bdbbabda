"""Toxicity: folding, exceptions, and held-out accuracy."""

import math
import random
import zlib

import pytest

from gridloom.llm.toxicity import Lexicon, fold, learn, toxicity

SCHEMA = "doc_id long, text string, score double, toxic int"


def test_folding():
    assert fold("Ｍ0r0n M0RÖN moron! rn$ron мoron l0ser 42 go!") == (" moron morön moron rnsron moron loser 42 go", " moron")
    assert fold("e\u0301t\u00e9") == (" été", " ete")
    assert fold(None) == fold("") == fold(" \n!?") == ("", "")


def test_exceptions_and_length():
    lexicon = Lexicon({"loser": 2.0, "lose": 1.0}, ["sore loser club", "loserville"])
    assert lexicon.features("a Loser here")[0] > 0
    assert not lexicon.features("the sore LOSER club").any() and not lexicon.features("in loserville").any()
    assert lexicon.features("the sore loser clubs")[0] > 0 and not lexicon.features("closer").any()
    assert lexicon.features("löser")[0] == lexicon.features("loser")[0]
    assert lexicon.features("loser")[1] > lexicon.features("loser " + "word " * 50)[1]
    assert not Lexicon({}, []).features("loser").any()


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 9)))
    rows, truth = [], {}
    for i in range(1500):
        words, toxic = [word() for _ in range(rng.choice([3, 30, 300]))], int(rng.random() < 0.2)
        for _ in range(rng.randrange(1, 4) * toxic):
            bad = rng.choice(["zorgling", "Zorgl1ng", "wuffer", "wuff3rs", "kratzor"]) + rng.choice(["", "", "ed"])
            words[rng.randrange(len(words))] = bad
        rows.append((i, " ".join(words), 0.0, 1))
        truth[i] = toxic
    rows += [(3000, None, 0.0, 0), (3001, "", 0.0, 0), (3001, "", 0.0, 0), (None, "zorgling wuffer", 0.0, 0), (3002, "word " * 100_000 + "zorgling kratzor wuffer", 0.0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, t) for i, t in truth.items()] + [(1, 1, None), (None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    held = [i for i in truth if by[i].held_out]
    hits = sum(by[i].predicted == truth[i] for i in held)
    assert hits / len(held) > 0.97
    assert not by[3000].predicted and not by[3001].predicted and by[None].predicted and by[3002].predicted


def test_without_labels_or_rows(spark):
    docs, none = spark.createDataFrame([(1, "a loser", 0.0, 0)], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity(docs, none).collect()] == [0]
    assert toxicity(docs.limit(0), none).count() == 0


def plain_features(lexicon, text):
    """features() by plain search: every word against every entry, every place against every exception."""
    kept, bare = fold(text)
    total, hit = 0.0, set()
    if not kept or not (lexicon.weights or lexicon.exceptions):
        return [0.0, 0.0, 0.0]
    for folded in (kept + " ", bare + " "):
        void = [(at, at + len(p)) for p in (fold(e)[0] for e in lexicon.exceptions) if p for at in range(len(folded)) if folded.startswith(p + " ", at)]
        for at, c in enumerate(folded[:-1]):
            word = folded[at + 1 :].split(" ")[0]
            worth = [w for e, w in lexicon.weights.items() if word.startswith(e)] if c == " " else []
            if worth and not any(a <= at < b for a, b in void):
                total += max(worth)
                hit.add(word)
    return [math.log1p(x) for x in (total, 100 * total / kept.count(" "), len(hit))]


def test_the_matcher_against_plain_search():
    rng = random.Random(9)
    word = lambda a=1, b=6: "".join(rng.choice("abcé0") for _ in range(rng.randrange(a, b)))
    for _ in range(150):
        lexicon = Lexicon({word(2, 5).replace("0", "o").replace("é", "e"): rng.random() + 0.1 for _ in range(6)}, [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(4)])
        for _ in range(6):
            text = " ".join(rng.choice([word(), word(), rng.choice(lexicon.exceptions), rng.choice([*lexicon.weights]) + word()]) for _ in range(rng.randrange(0, 25)))
            assert lexicon.features(text) == pytest.approx(plain_features(lexicon, text))


def test_conflicting_labels_and_repeated_ids(spark):
    docs = [(i, "vile creature gone" if i < 40 else f"plain words number {i}") for i in range(200)]
    docs = docs + [(3, "aaa another text of that id")] * 50
    labels = [(i, int(i < 40)) for i in range(200)] + [(5, 0), (60, 1), (7, 1), (8, None)]
    frame = spark.createDataFrame([(i, t, 0.0, 1) for i, t in docs], SCHEMA)
    same = learn(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    without = learn(spark.createDataFrame([(i, t, 0.0, 1) for i, t in dict(docs).items() if i not in (5, 60)], SCHEMA), spark.createDataFrame([x for x in labels if x[0] not in (5, 60)], "doc_id long, toxic int"))
    assert same.weights == without.weights and same.model == pytest.approx(without.model)
