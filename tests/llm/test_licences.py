"""Licence scans against every window of every text."""

import random
from collections import Counter

import pytest

from gridloom.llm.licences import MORE, TEMPLATES, Scanner, licence_scan, normalised

SCHEMA = "doc_id long, text string, best double, spans string"


def best_windows(text, templates, dice):
    """Whether any window matches each template, by trying all."""
    words, out = normalised(text or ""), set()
    pairs = [*zip(words, words[1:])]
    for name, t in templates.items():
        w = normalised(t)
        want = Counter(zip(w, w[1:]))
        n = sum(want.values())
        if any(2 * sum((Counter(pairs[i:j]) & want).values()) >= dice * (j - i + n) - 1e-9 for i in range(len(pairs)) for j in range(i + 1, min(len(pairs), i + 3 * n) + 1)):
            out.add(name)
    return out


@pytest.mark.parametrize("dice", [0.5, 0.8, 1.0])
def test_no_window_is_missed(dice):
    rng, scanner = random.Random(1), Scanner(TEMPLATES, dice)
    words = sorted({w for t in TEMPLATES.values() for w in normalised(t)})[:60]
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(12))
        for name in rng.sample(sorted(TEMPLATES), 2):
            part = TEMPLATES[name].split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = rng.choice(words)
            text += " " + " ".join(part).upper() + "\n" + rng.choice(words)
        got, want = scanner.scan(text), best_windows(text, TEMPLATES, dice)
        assert bool(got) == bool(want) and {n for *_, n, _ in got} <= want
        assert all(a < b <= c for (_, b, *_), (c, *_), a in zip(got, got[1:], [x[0] for x in got]))
        assert all(s >= dice - 1e-9 for *_, s in got)


def test_table(spark):
    mit = "Intro é.\nReleased under  the MIT\nLicense!\nrest"
    rows = [(1, mit), (2, None), (3, ""), (3, ""), (4, "MIT"), (5, "word of the " * 50_000 + "All rights reserved."), (6, TEMPLATES["gpl-header"].replace("\n", " ").lower()), (None, "İİ Licensed under CC BY-NC 4.0."), (7, "the license of the work is under the version of the software")]
    got = {(r.doc_id, r.n_matches): r for r in licence_scan(spark.createDataFrame([(*r, 0.0, "") for r in rows], SCHEMA)).collect()}
    r = got[1, 1]
    a, b = map(int, r.spans.split(":")[1:])
    assert r.licences == "mit" and mit[a:b] == "Released under  the MIT\nLicense" and r.best == 1.0
    assert got[5, 1].licences == "proprietary" and got[6, 1].licences == "gpl-header"
    a, b = map(int, got[None, 1].spans.split(":")[1:])
    assert rows[-2][1][a:b] == "Licensed under CC BY-NC 4.0"
    assert {k for k in got if k[1] == 0} == {(2, 0), (3, 0), (4, 0), (7, 0)}
    assert licence_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_siblings_and_whole_texts(spark):
    """Each covered notice is reported under its own name, and not under that of a sibling."""
    names = ["gpl-2.0", "lgpl-2.1", "agpl-3.0", "cc-by-nc-4.0", "cc-by-sa-4.0", "cc-by-nc-sa-4.0", "cc-by-sa-4.0", "cc0-1.0", "mit-whole", "bsd-3-clause", "gpl-2.0-header"]
    texts = [
        "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "This work is licensed under the GNU Affero General Public License, version 3.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", MORE["cc0-1.0"], MORE["mit-whole"], MORE["bsd-3-clause"], MORE["gpl-2.0-header"]]
    rows = [(i, "Some words before. " + t + " And after it.", 0.0, "") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in licence_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].n_matches == 1 and got[i].best == 1.0 and got[i].licences.removesuffix("-long").removesuffix("-short") == name for i, name in enumerate(names)), got
    scanner = Scanner(TEMPLATES | MORE)
    assert all([n for *_, n, _ in scanner.scan(t)] == [name] for name, t in (TEMPLATES | MORE).items())


def test_many_notices_take_time_in_proportion():
    """Each of thousands of notices is found, and the choice among overlapping matches isn't quadratic in them."""
    import time

    scanner, notice = Scanner(TEMPLATES), "Released under the MIT License. Some other words here. "
    times = []
    for n in (500, 4000):
        began = time.process_time()
        assert [x[2] for x in scanner.scan(notice * n)] == ["mit"] * n
        times.append(time.process_time() - began)
    assert times[1] < 24 * max(times[0], 0.02)
