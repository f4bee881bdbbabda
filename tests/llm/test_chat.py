"""Chat formatting: an exact round trip, and the loss mask."""

import hashlib
import random
from itertools import groupby

from gridloom.llm.chat import chat_digest, formatted

SCHEMA = "conv_id long, turn long, role string, text string, loss string, turns long"
BITS = ["</s>", "<s>", "[INST]", "[/INST]", "[!INST]", "<!/s>", "</!s>", "[NEXT]", "[TEXT]", "[ROLE]", "[/ROLE]", "[ANS]", "[[INST]", "é🙂", "\n", "$1", "\\", "a b", "[", "]", "<", "!"]


def rows_of():
    rng, rows = random.Random(1), []
    for c in range(40):
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system", "[TEXT]x", None]), rng.choice([None, "", "".join(rng.choice(BITS) for _ in range(8))])))
    rows += [(50, 1, "user", "same"), (50, 1, "user", "same"), (50, None, "system", "first"), (None, 0, "user", "no id"), (51, 0, None, None), (52, 0, "assistant", "long [INST] " * 30_000)]
    rows += [(53, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(1500)]
    rng.shuffle(rows)
    return rows


def test_round_trip(spark):
    rows = rows_of()
    got = {r.conv_id: r for r in chat_digest(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        r, loss = got[c], "".join(t for _, _, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, _, role, t in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.n_blocks == len([*groupby(role for _, _, role, _ in turns)])


def test_layout(spark):
    rows = [(1, 0, "user", "a[/INST]"), (1, 1, "user", "b"), (1, 2, "assistant", "é</s>"), (1, 3, "tool", "x")]
    r = formatted(spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA)).first()
    assert r.text == "<s>[INST]a[/!INST][NEXT]b[/INST][ANS]é</!s></s>[ROLE]tool[TEXT]x[/ROLE]"
    assert [r.text.encode()[s["from"] : s["to"]].decode() for s in r.loss] == ["é</!s>"]


def test_empty(spark):
    assert chat_digest(spark.createDataFrame([], SCHEMA)).count() == 0
