"""Quality rules and personal data against plain Python, and on edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from gridloom.llm.exact_dedup import keep_first
from gridloom.llm.pii import KINDS, personal_data, sanitised
from gridloom.llm.quality import keep_good, quality
from gridloom.llm.simhash import keep_nearest_first

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, words string, removed string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", s, len(t or ""), 1, "w", "r") for i, t, s in rows], SCHEMA)


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def line_key(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")


def brute_kept(rows):
    """The verdict by its definition, in plain dicts."""
    documents, held = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        documents[s or ""].add(line_key(t or ""))
        for x in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                held[s or "", line_key(x)].add(line_key(t or ""))
    often = {(host, k) for (host, k), by in held.items() if len(by) > 10 and len(by) > 0.005 * len(documents[host])}
    out = []
    for i, t, s in rows:
        t, s = t or "", s or ""
        n, _, _, _, repeated = base_counts(t)
        gone = sum(len(x.split()) for x in t.split("\n") if (s, line_key(x)) in often and x.strip())
        out.append((i, n < 20 or 100 * repeated > 30 * n, not (n < 20 or 100 * repeated > 30 * n) and n - gone >= 0.2 * n, gone))
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    boiler = " ".join(word() for _ in range(25)) + " 2024"
    rows = [(i, "\n".join([boiler.replace("2024", str(2000 + i)), " ".join(word() for _ in range(rng.randrange(1, 60)))]), "h") for i in range(40)]
    rows += [(100, boiler, "h"), (101, boiler + "\n" + boiler, "h"), (102, boiler, "other"), (103, None, None), (104, "", "h"), (105, " \n\t \n ", None), (105, " \n\t \n ", None), (None, "x # % | <a> " * 30, "h")]
    rows += [(200 + i, "\n".join(f"{k} " + " ".join(word() for _ in range(9)) for k in "pqr") + "\n" + rows[0][1] * (i % 3), "h") for i in range(20)]
    copied = "\n".join(" ".join(word() for _ in range(12)) for _ in range(6))
    rows += [(300 + i, copied.replace(" ", "  " if i % 2 else " ", i), "h") for i in range(30)]
    foot = [" ".join(word() for _ in range(4)) for _ in range(5)]
    rows += [(500 + i, "\n".join([*foot[: i % 2 * 5], *(" ".join(word() for _ in range(60)) for _ in range(3)), *foot]), "h") for i in range(40)]
    rows += [(600 + i, "\n".join([*foot, *foot, word()]), "h") for i in range(3)]
    rows += [(400, "long " * 50_000, "h"), (401, " ".join(map(str, range(30_000))), "h")]
    return rows


def test_quality(spark):
    rows = corpus()
    got = quality(frame(spark, rows)).collect()
    key = lambda r: (str(r[0]), *map(int, r[1:]))
    assert sorted(key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == sorted(key((i, *base_counts(t or ""))) for i, t, _ in rows)
    assert sorted(key((r.doc_id, r.base_failed, r.kept, r.n_removed_words)) for r in got) == sorted(key(x) for x in brute_kept(rows))
    verdict = {r.doc_id: r for r in got}
    assert not verdict[100].base_failed and not verdict[100].kept and verdict[102].kept
    assert all(verdict[300 + i].kept for i in range(30)) and not any(verdict[600 + i].kept for i in range(3))


def test_quality_keeps_columns_and_drops_lines(spark):
    rows = corpus()
    out = keep_good(frame(spark, rows))
    assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    want = sorted(str(i) for i, _, kept, _ in brute_kept(rows) if kept)
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)
    start = rows[0][1][:40]
    assert not any(start in r.text for r in got if r.source == "h" and (r.doc_id or 999) < 200)
    foot = next(t for i, t, _ in rows if i == 500).split("\n")[3:]
    assert len(foot) == 5 and not any(line in r.text for r in got for line in foot if 500 <= (r.doc_id or 0) < 540)
    assert sum(500 <= (r.doc_id or 0) < 540 for r in got) == 40
    assert any(r.doc_id == 300 and r.text == next(t for i, t, _ in rows if i == 300) for r in got)


def clashing(spark, rows, *names):
    """frame(), with more columns of those names, one of them with a dot."""
    out = frame(spark, rows).drop("key", "words", "removed")
    for name in (*names, "a.b"):
        out = out.withColumn(name, F.lit(f"<{name}>"))
    return out


HELPERS = "own _own OWN at who gone ruled removed host raw_key text_key rid key lines kept s l marks hidden spans entity term fp n least doc base_failed _id _at _removed _marks".split()


@pytest.mark.parametrize("step", [keep_good, sanitised, keep_first, keep_nearest_first])
def test_clashing_columns(spark, step):
    rows = [r for r in corpus() if r[0] is None or r[0] < 110 or r[0] >= 500] + [(700, "write to jo@ex.org " + " ".join(map(str, range(40))), None)]
    names = [n for k, n in enumerate(HELPERS) if n.lower() not in {x.lower() for x in HELPERS[:k]}]
    plain, more = step(frame(spark, rows)), step(clashing(spark, rows, *names))
    assert more.columns == ["doc_id", "text", "lang", "source", "n_chars", *names, "a.b"]
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["n_chars"])
    got = more.collect()
    assert sorted(map(key, got)) == sorted(map(key, plain.collect()))
    assert all(r[n] == f"<{n}>" for r in got for n in (*names, "a.b"))


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_spans(text):
    # The plain e-mail pattern takes quadratic time over long runs, so texts without @ are spared it.
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) if k or "@" in text for m in re.finditer(p, text) if ok(m[0]))


def texts_with_data():
    rng = random.Random(6)
    bits = ["a@b.co", "x.y+z@mail-1.example.org.", "@", "é@ü.de", "1.2.3.4", "256.1.1.1", "0001.02.3.255.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "37828224631000599", "+1 (555) 010-9999", "+49.30.1234567.", "+1 2", "a@b", "me@a.b-c@d.e", "..@..", "été", "\n", " ", "12345678901234567890", "+", "9"]
    out = ["".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(1, 14))) for _ in range(250)]
    return out + [None, "", "é" * 5000 + " a@b.co", "1" * 50_000, "a" * 200_000, "a." * 10_000 + "@", "a." * 100_000, "7 " * 40_000, "+1" * 9000, "u@v.ww " * 3000]


def test_personal_data(spark):
    rows = [(i, t, "s") for i, t in enumerate(texts_with_data())] + [(1, "a@b.co", "s"), (1, "a@b.co", "s"), (None, "1.2.3.4", None)]
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in personal_data(frame(spark, rows)).collect())
    want = []
    for i, t, _ in rows:
        spans = base_spans(t or "")
        want.append((str(i), *(sum(k == x for _, k, _ in spans) for x in range(4)), hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()))
    assert got == sorted(want)


TERM = regex.compile(r"(?<![\p{L}0-9@._%+-])\p{L}{2,}+(?![0-9@_%+-]|\.\S)")


def brute_terms(rows, support=2, generalise=0.8, remove=0.95):
    """term -> removed, for each text: every term of every text against every entity, by the definition."""
    texts = {t or "" for _, t, _ in rows}
    terms = {t: {m[0].lower() for m in TERM.finditer(t)} for t in texts}
    entities = {t: set() for t in texts}
    for t in texts:
        for a, k, b in base_spans(t):
            value = t[a:b].lower() if k < 2 else re.sub("[^0-9]", "", t[a:b])
            entities[t] |= {f"{KINDS[k]}:{value}"} | ({"domain:" + value.split("@")[1]} if k == 0 else set())
    df_term = Counter(w for t in texts for w in terms[t])
    df_entity = Counter(e for t in texts for e in entities[t])
    both = Counter((e, w) for t in texts for e in entities[t] for w in terms[t])
    told, n = defaultdict(dict), len(texts)
    for (e, w), k in both.items():
        if k >= support and df_entity[e] < n:
            share = math.log2(k * n / df_term[w] / df_entity[e]) / math.log2(n / df_entity[e])
            if share >= generalise:
                told[e][w] = share >= remove
    out = {}
    for t in texts:
        mine = {}
        for e in entities[t]:
            for w, gone in told[e].items():
                mine[w] = mine.get(w, False) or gone
        out[t] = sorted((m.start(), m.end(), mine[m[0].lower()]) for m in TERM.finditer(t) if m[0].lower() in mine)
    return out


def disclosed_rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    far = lambda: " ".join(word() for _ in range(60))
    rows = [(i, f"{word()} the Zorblatt of {word()} {far()} wrote to boss{i % 2}@corp.example about {word()} the end, zorblatt", "s") for i in range(8)]
    rows += [(100 + i, f"the {word()} about the {word()} of one {far()}", "s") for i in range(120)] + [(1200 + i, "copied rareword lone@mail.example", "s") for i in range(9)]
    rows += [(300 + i, f"Wú {far()} +1 (555) 010-99{i % 5}9 {far()} Wú éa+b@x.example {word()}.", "s") for i in range(30)]
    return rows + [(400, "zorblatt " * 20_000 + "boss0@corp.example", "s"), (401, "zorblatt and rareword alone", "s"), (402, None, None), (403, "", "s")]


def test_terms_that_disclose(spark):
    rows = disclosed_rows()
    got, want = {r.doc_id: r for r in personal_data(frame(spark, rows)).collect()}, brute_terms(rows)
    for i, text, _ in rows:
        spans = sorted([(a, k, b) for a, k, b in base_spans(text or "")] + [(a, 4, b) for a, b, _ in want[text or ""]])
        assert got[i].spans == ",".join(f"{(*KINDS, 'term')[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i].n_term == len(want[text or ""])
    assert all(got[i].n_term >= 2 for i in range(8)) and got[400].n_term == 20_000
    assert all(got[i].n_term == 0 for i in [*range(100, 220), *range(1200, 1209), 401]) and any(got[i].n_term for i in range(300, 330))
    out = {r.doc_id: r for r in sanitised(frame(spark, rows)).collect()}
    assert all("orblatt" not in out[i].text and "[EMAIL]" in out[i].text and out[i].n_chars == len(out[i].text) for i in [*range(8), 400])
    assert all(out[i].text == t for i, t, _ in rows if not base_spans(t or ""))
    for i, t, _ in rows:
        marks = sorted([(a, k, b, f"[{KINDS[k].upper()}]") for a, k, b in base_spans(t or "")] + [(a, 4, b, "" if gone else "[TERM]") for a, b, gone in want[t or ""]])
        if marks:
            cut, at = [], 0
            for a, _, b, mask in marks:
                cut += [t[at:a], mask] if a >= at else []
                at = max(at, b)
            assert out[i].text == "".join(cut) + t[at:]


def travelled(spark):
    """Records written to shuffles so far."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}


@pytest.mark.parametrize("copies", [0, 40])
def test_words_of_texts_do_not_travel(spark, copies):
    """However large the tables are (none is broadcast), the terms of a text are counted where it is read; copies count once."""
    rng = random.Random(8)
    words = ["w" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    text = lambda i: " ".join(rng.sample(words, 100)) + (f" zorblatt boss{i % 4}@corp.example" if i % 60 == 0 else "")
    rows = [(i, text(i), "s") for i in range(1500)]
    rows += [(2000 + i, rows[i * 30][1], "s") for i in range(copies)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = travelled(spark)
        got = {r.doc_id: r.n_term for r in personal_data(frame(spark, rows)).collect()}
        records = sum(n for stage, n in travelled(spark).items() if stage not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = brute_terms(rows)
    assert got == {i: len(want[t]) for i, t, _ in rows} and any(got.values())
    assert records < sum(len(t.split()) for _, t, _ in rows) / 2


def test_sanitised_text(spark):
    rows = [(i, t, "s") for i, t in enumerate(texts_with_data())]
    got = {r.doc_id: r.text for r in sanitised(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        if t is None:
            assert got[i] is None
            continue
        out, at = [], 0
        for a, k, b in base_spans(t):
            out.append(t[at:a] if a > at else "")
            out.append(f"[{KINDS[k].upper()}]" if a >= at else "")
            at = max(at, b)
        assert got[i].replace("[TERM]", "").count("@") <= t.count("@")
        if "[TERM]" not in got[i] and not any(c.isalpha() for c in re.sub("|".join(p for _, p, _ in BASE), "", t)):
            assert got[i] == "".join(out) + t[at:]


def test_empty(spark):
    none = frame(spark, [])
    assert [f(none).count() for f in (quality, keep_good, personal_data, sanitised)] == [0, 0, 0, 0]
    assert math.isfinite(np.float64(1))
