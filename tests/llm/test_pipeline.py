"""The pipeline's stages against their brute-force versions, each on its own input."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from test_dedup import brute_similar, norm
from test_native import BASE, base_spans, brute_kept
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    boiler, rows = line(6), []
    for i in range(60):
        rows.append((i, f"{boiler}\n{line(60)}\n{line(50)}", "xx", "a", 1))
    for i in range(12):
        rows.append((100 + i, rows[i][1].replace("\n", " \n", 1) if i % 2 else rows[i][1], "xx", "b", 1))
    for i in range(12):
        words = rows[20 + i][1].split(" ")
        words[-2] = "edited"
        rows.append((200 + i, " ".join(words), "xx", "c", 1))
    rows += [(300, "too short", "xx", "a", 1), (301, None, None, None, None), (302, "again and " * 60, "xx", "a", 1), (303, f"{line(30)} jo@ex.org {line(30)} 10.0.0.1 +1 (555) 123-4567 {line(9)}", "xx", "a", 1)]
    return rows


def test_stages(spark):
    frame = spark.createDataFrame(corpus(), SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality rules", "exact dedup", "near dedup", "personal data", "packing"]
    docs, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = materialize(stage(spark, docs, ""), "test")
        assert docs.columns == frame.columns
        seen[name] = (before, {r["doc_id"]: r for r in docs.collect()})
    before, after = seen["quality rules"]
    assert {i for i, _, kept, _ in brute_kept([(r[0], r[1], r[3]) for r in before]) if kept} == set(after)
    assert set(range(60)) <= set(after) and not {300, 301, 302} & set(after)
    before, after = seen["exact dedup"]
    first = {}
    for i, t, *_ in before:
        first[norm(t)] = min(i, first.get(norm(t), i))
    assert set(first.values()) == set(after) and len(after) < len(before)
    before, after = seen["near dedup"]
    root = brute_similar([t for _, t, *_ in before])
    least = {c: min(i for (i, *_), x in zip(before, root) if x == c) for c in root}
    assert set(least.values()) == set(after) and len(after) < len(before)
    before, after = seen["personal data"]
    assert set(after) == {r[0] for r in before}
    for i, t, *_ in before:
        assert (after[i]["text"] == t) == (not base_spans(t)) and after[i]["n_chars"] == (len(after[i]["text"]) if base_spans(t) else [r[4] for r in before if r[0] == i][0])
    assert all(x in after[303]["text"] for x in ("[EMAIL]", "[IP]", "[PHONE]")) and len(BASE) == 4
    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    for r in corpus_pipeline.packing(spark, docs, "").collect():
        pieces[r["doc_id"]].append(r)
    for i, row in after.items():
        ids = [*tokenizer.encode(row["text"], add_special_tokens=False).ids, 2]
        for r in pieces[i]:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in pieces[i]) == len(ids)


def test_whole_run_and_empty_input(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(tmp_path / "some/documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert out.count() > 0 and out.columns[0] == "doc_id" and corpus_pipeline.ORACLE_SQL is None
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
