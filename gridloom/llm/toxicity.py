"""Toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts and lexicon are folded: compatibility forms, case, homoglyphs of other scripts, and digits or signs that
stand for letters inside a word; a word with accents is matched as it is and without them. The lexicon holds
beginnings of words, learned from labelled texts: of the beginnings that toxic texts show at many times the rate of others, those
that explain the most toxic texts not yet explained often enough are taken, each with its log-odds as weight. Words that begin like an entry but are found in other texts are exceptions, as are
phrases that are given; where an exception holds a match, the match is void. The hits' weights, their sum for
each word of the text, and the number of words hit give the score through a logistic model.

The sample that is learned from is bounded (SAMPLE_TOXIC, SAMPLE_OTHER, chosen by a hash of doc_id); scoring
runs over whole texts, row by row, with no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize

#: Labelled rows to learn from, at most so many of each label.
SAMPLE_TOXIC, SAMPLE_OTHER = 6_000, 18_000
#: Parameters of the model. Lengths of beginnings (a longer word is an entry by its first letters); toxic texts that must show one; how many times the rate of other texts that must be; times each toxic text is to be explained; entries at most.
SHORTEST, LONGEST, SUPPORT, RATIO, COVER, ENTRIES = 4, 8, 3, 10, 3, 1000
THRESHOLD = 0.3

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("абвгдеёзикмнорстухіјѕԁԛԝһӏαβγεηικνορτυχωıøłđħŀ", "abbrdeezukmhopctyxijsdqwhlabyenikvoptuxwioldhl", strict=True))
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
INSIDE = re.compile(r"(?<=[^\W_])[0-9@$!|](?=[^\W_])|(?<![^\s])[0-9@$](?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+")


class _Fold(dict):
    """What each code point becomes: made when it is met, for str.translate."""

    def __init__(self, accents: bool):
        super().__init__()
        self.accents = accents

    def __missing__(self, point: int) -> str:
        plain = unicodedata.normalize("NFKD", chr(point).lower()).lower()
        bare = "".join(HOMOGLYPHS.get(c, c) for c in plain if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        marks = [c for c in plain if unicodedata.combining(c)] if self.accents else []
        self[point] = out = unicodedata.normalize("NFC", "".join([bare, *marks]))
        return out


_kept, _bare = _Fold(True), _Fold(False)


def fold(text: str | None) -> tuple[str, str]:
    """The folded words, each with a space in front; then those that lose an accent, without it."""
    folded = INSIDE.sub(lambda m: SUBSTITUTES.get(m[0], m[0]), (text or "").translate(_kept))
    words = WORD.findall(unicodedata.normalize("NFC", folded))
    return "".join([" " + w for w in words]), "".join([" " + w.translate(_bare) for w in words if not w.isascii()])


def words_of(text: str | None) -> set[str]:
    return set("".join(fold(text)).split(" ")) - {""}


def beginnings(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in range(SHORTEST, LONGEST + 1) if len(w) >= n}


@dataclass
class Lexicon:
    """weights by beginning of a word; exceptions: phrases (folded) in which matches are void; model: bias and weights of the features; machine: built once a worker."""

    weights: dict[str, float]
    exceptions: list[str]
    model: tuple[float, ...] = (-6.0, 1.0, 1.0, 1.0)

    def machine(self) -> ahocorasick.Automaton | None:
        if not hasattr(self, "_machine"):
            self._machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._machine.add_word(" " + entry, (len(entry), entry, weight))
            for phrase in self.exceptions:
                folded = fold(phrase)[0]
                if folded:
                    self._machine.add_word(folded + " ", (len(folded), None, 0.0))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine if len(self._machine) else None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "model": self.model}

    def features(self, text: str | None) -> np.ndarray:
        """log(1 + x) of the hits' weights, of a hundred times that for each word, and of the number of different words hit."""
        kept, bare = fold(text)
        machine = self.machine()
        if machine is None or not kept:
            return np.zeros(3)
        total, hit = 0.0, set()
        for folded in (kept + " ", bare + " "):
            found, void = {}, []
            for end, (size, entry, weight) in machine.iter(folded):
                if entry is None:
                    void.append((end - size, end))
                else:  # entries that begin alike count once a word
                    found[end - size] = max(found.get(end - size, 0.0), weight)
            void.sort()
            starts, reach = [a for a, _ in void], [*accumulate((b for _, b in void), max)]
            for start, weight in found.items():
                k = bisect_right(starts, start) - 1
                word = folded[start + 1 : folded.index(" ", start + 2)]
                if k < 0 or reach[k] <= start:
                    total += weight
                    hit.add(word)
        return np.log1p([total, 100 * total / kept.count(" "), len(hit)])

    def score(self, text: str | None) -> float:
        z = self.model[0] + float(np.dot(self.model[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _counted(sample: DataFrame) -> DataFrame:
    """feature, toxic, other: texts of the sample that show each beginning."""

    def run(batches):
        counts = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                counts.update((f, toxic) for f in beginnings(words_of(text.as_py())))
        items = [*counts.items()]
        for at in range(0, len(items), 100_000):
            some = items[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([f for (f, _), _ in some], pa.string()), pa.array([n * t for (_, t), n in some], pa.int64()), pa.array([n * (1 - t) for (_, t), n in some], pa.int64())], ["feature", "toxic", "other"])

    return sample.mapInArrow(run, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _chosen(shown: list[set[str]], candidates: dict[str, tuple[int, int]], cost: float) -> list[str]:
    """Greedy multiple cover of the toxic texts (the candidates each shows), less cost for each other text; shorter beginnings win ties."""
    need, gain, where = [min(COVER, len(s)) for s in shown], Counter(), {}
    for i, s in enumerate(shown):
        for f in s:
            gain[f] += 1
            where.setdefault(f, []).append(i)
    out: list[str] = []
    while len(out) < ENTRIES and gain:
        best = max(gain, key=lambda f: (gain[f] - candidates[f][1] * cost, -len(f), f))
        if gain[best] < SUPPORT:
            break
        out.append(best)
        same = {f for f in gain if f.startswith(best) or best.startswith(f)}
        for i in where[best]:
            if need[i] > 0:
                need[i] -= 1
                if need[i] == 0:
                    for f in shown[i]:
                        gain[f] -= 1
        for f in same:
            del gain[f]
    return out


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), toxic_rows: int = SAMPLE_TOXIC, other_rows: int = SAMPLE_OTHER) -> Lexicon:
    """Learns from labelled rows; labels: doc_id, toxic. Without toxic rows the lexicon is empty and all scores are low.

    Rows with another label than 0 and 1 are left out, and so are ids with both labels; of documents that share an id the least text
    counts. The model is fitted on a sample and is bounded in every part: at most toxic_rows and other_rows labelled rows; 20 * ENTRIES
    candidates, those that most toxic texts show; ENTRIES entries; ENTRIES exceptions, those that most other texts show.
    Scores are then computed for all rows from whole texts.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("toxic").cast("long").alias("toxic"), F.max("toxic").alias("most"))
    known = known.filter("toxic = most").select("_id", "toxic")
    some = lambda toxic, most: known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("_id"), "_id").limit(most)
    # At most toxic_rows + other_rows pairs of an id and a label: they go to the texts, not the texts to them.
    known = F.broadcast(materialize(some(1, toxic_rows).unionByName(some(0, other_rows)), "toxicity-labels"))
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(known, F.col("doc_id") == F.col("_id"))
    sample = materialize(sample.groupBy("_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return Lexicon({}, [*exceptions])
    counted = _counted(sample).filter((F.col("toxic") >= SUPPORT) & (F.col("toxic") * n_other > RATIO * F.col("other") * n_toxic))
    candidates = {r["feature"]: (r["toxic"], r["other"]) for r in counted.orderBy(F.desc("toxic"), "feature").limit(20 * ENTRIES).collect()}

    def run(batches):
        for batch in batches:
            rows = [sorted(beginnings(words_of(t.as_py())) & candidates.keys()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["shown"])

    shown = [set(r["shown"]) for r in sample.filter("toxic = 1").select("text").distinct().mapInArrow(run, "shown array<string>").collect()]
    weight = lambda t, o: float(np.log((t + 0.5) / (n_toxic + 1)) - np.log((o + 0.5) / (n_other + 1)) - np.sqrt(1 / (t + 0.5) + 1 / (o + 0.5)) / 2)
    weights = {f: w for f in _chosen(shown, candidates, 2 * n_toxic / max(1, n_other)) if (w := weight(*candidates[f])) > 1}
    lexicon = Lexicon(weights, [*exceptions])

    def whole_words(batches):
        counts = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                counts.update((w, toxic) for w in words_of(text.as_py()) if any(w[:n] in weights for n in range(SHORTEST, LONGEST + 1)))
        rows = [*counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([w for (w, _), _ in rows], pa.string()), pa.array([t for (_, t), _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], ["word", "toxic", "n"])

    met = sample.mapInArrow(whole_words, "word string, toxic long, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("other"))
    lexicon.exceptions += [r["word"] for r in met.filter((F.col("other") >= 2) & (F.col("other") * n_toxic >= F.col("toxic") * n_other)).orderBy(F.desc("other"), "word").limit(ENTRIES).collect()]

    def measured(batches):
        for batch in batches:
            rows = np.array([lexicon.features(t.as_py()) for t in batch.column("text")]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in rows.T], batch.column("toxic")], ["a", "b", "c", "toxic"])

    x = sample.mapInArrow(measured, "a double, b double, c double, toxic long").groupBy("a", "b", "c", "toxic").count().orderBy("a", "b", "c", "toxic").toPandas().to_numpy(float)
    lexicon.model = logistic(x[:, :3], x[:, 3], x[:, 4])
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    """Newton's method with a ridge, on weighted rows."""
    design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    keep = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design.T * (n * p * (1 - p))) @ design + keep, design.T @ (n * (y - p)) - keep @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score for each row of docs. Null, empty and blank texts have no hits and get the model's lowest score; rows that repeat get equal scores; columns besides doc_id and text aren't read."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([lexicon.score(t.as_py()) for t in batch.column("text")], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs; learned from labels outside the held-out fold (crc32 of doc_id as text, modulo folds). Rows without doc_id are not held out."""
    out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % folds == held, F.lit(False))
    lexicon = learn(docs, labels.filter(~out("doc_id")), **options)
    found = scored(docs, lexicon)
    return found.select("doc_id", out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
