"""The models of problem 9 count every word of every graded document, however many there are."""

import math
import zlib
from collections import Counter
from statistics import median

import pyarrow as pa
import pytest

from codelattice.llm import grams
from codelattice.llm import reading as G
from test_reading import EASY, HARD, tables, text


class Ngrams:
    """Interpolated trigram model; begin of sentence is the empty word."""

    def __init__(self, sentences, vocabulary: int):
        self.n1, self.n2, self.n3 = Counter(), Counter(), Counter()
        for s in sentences:
            p = q = ""
            for w in s:
                self.n1[w] += 1
                self.n2[q, w] += 1
                self.n3[p, q, w] += 1
                p, q = q, w
        self.total, self.size = sum(self.n1.values()), vocabulary
        self.c2, self.k2, self.c3, self.k3 = Counter(), Counter(), Counter(), Counter()
        for (q, _), n in self.n2.items():
            self.c2[q] += n
            self.k2[q] += 1
        for (p, q, _), n in self.n3.items():
            self.c3[p, q] += n
            self.k3[p, q] += 1

    def bits(self, p: str, q: str, w: str) -> float:
        kinds = len(self.n1)
        x = (self.n1[w] + kinds / self.size) / (self.total + kinds) if self.total else 1 / self.size
        if c := self.c2[q]:
            k = self.k2[q]
            x = (self.n2[q, w] + k * x) / (c + k)
        if c := self.c3[p, q]:
            k = self.k3[p, q]
            x = (self.n3[p, q, w] + k * x) / (c + k)
        return -math.log2(x)


class BruteForce:
    """Models and steps fitted in one process by dictionaries, from all that is given."""

    def __init__(self, graded: list[tuple[list[list[str]], float]]):
        self.size = len({w for s, _ in graded for x in s for w in x}) + 1000
        # Copies of one text must not vouch for each other: they share a fold.
        folds = [zlib.crc32(" ".join(w for x in s for w in x).encode()) % grams.FOLDS for s, _ in graded]
        agreed = [True] * len(graded)
        for _ in range(2):
            scores: list[float | None] = [None] * len(graded)
            for k in range(grams.FOLDS):
                self.train([x for x, f, a in zip(graded, folds, agreed) if f != k and a])
                for i, (s, _) in enumerate(graded):
                    if folds[i] == k:
                        scores[i] = self.score(s)
            self.steps = G.isotonic([(x, g) for x, (_, g) in zip(scores, graded) if x is not None])
            agreed = [x is None or (self.level(x) > G.DEMANDING) == (g >= 4) for x, (_, g) in zip(scores, graded)]
        self.train([x for x, a in zip(graded, agreed) if a])

    def train(self, graded) -> None:
        """Fit both models; documents whose graders disagree about the border are in neither."""
        self.easy = Ngrams((x for s, g in graded if g <= 3 for x in s), self.size)
        self.hard = Ngrams((x for s, g in graded if g >= 4 for x in s), self.size)
        self.cache: dict = {}

    def distribution(self, sentences: list[list[str]]) -> list[tuple[float, int]]:
        """Of each sentence the bounded mean difference of surprisal, easy model less demanding model, and its words."""
        out = []
        cache, easy, hard = self.cache, self.easy, self.hard
        for s in sentences:
            d = 0.0
            for g in zip(["", "", *s], ["", *s], s):
                x = cache.get(g)
                if x is None:
                    x = easy.bits(*g) - hard.bits(*g)
                    cache[g] = x
                d += x
            out.append((max(-grams.BOUND, min(grams.BOUND, d / len(s))), len(s)))
        return out

    def score(self, sentences: list[list[str]]) -> float | None:
        """Mean of the distribution over words; None without prose."""
        return G.mean_of(self.distribution(sentences))

    def level(self, score: float) -> float:
        return G.Level(None, self.steps).level(score)


def fitted(docs, labels):
    """The brute force fit of these tables, and the prose by document row."""
    grades = {}
    for r in labels.where("doc_id is not null and level is not null").collect():
        grades.setdefault(r["doc_id"], []).append(r["level"])
    rows = [(r["doc_id"], G.prose_sentences(r["text"] or "")) for r in docs.collect()]
    return BruteForce([(s, median(grades[k])) for k, s in rows if k in grades and G.language(s) == "en"]), rows


def by_id(rows):
    return sorted(rows, key=lambda x: (x[0], x[1] is None, x[1]))


def levels(docs, labels):
    return by_id([(r["doc_id"], r["level"], r["low"], r["median"], r["high"]) for r in G.reading_levels(docs, labels).collect()])


def expected(docs, labels):
    fit, rows = fitted(docs, labels)
    out = []
    for k, s in rows:
        values = fit.distribution(s) if G.language(s) == "en" else []
        out.append((k, fit.level(G.mean_of(values)) if values else None, *G.quantiles(values)))
    return by_id(out)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=1e-9), (g, w)


def wide(spark):
    """More than 1,500 graded texts, one of 40,000 words and one that is read in several parts; copies and split grades too."""
    docs, labels, _ = tables(spark)
    more = [(k, text(HARD if k % 2 else EASY, k, 3), 1) for k in range(3000, 4600)]
    more += [(5000, text(HARD, 1, 2_000) + " ".join(f"The {a}{b} has a tree." for a in "abcdefghij" for b in "klmnopqrst"), 1), (5001, text(EASY, 2, 50_000), 1)]
    marks = [(k, 4 if k % 2 else 2, "r1") for k in range(3000, 4600)] + [(5000, 5, "r1"), (5001, 1, "r1"), (7, 5, "r2"), (11, 5, "r3"), (904, 3, "r1"), (904, 4, "r2")]
    return docs.unionByName(spark.createDataFrame(more, docs.schema)), labels.unionByName(spark.createDataFrame(marks, labels.schema))


def test_all_graded_words_count(spark):
    docs, labels = wide(spark)
    same(levels(docs, labels), expected(docs, labels))


def test_counts_that_are_joined(spark, monkeypatch):
    docs, labels = wide(spark)
    docs = docs.where("doc_id < 400 or doc_id > 4500 or doc_id between 900 and 910")
    monkeypatch.setattr(grams, "MAX_TRIGRAMS", 10)
    same(levels(docs, labels), expected(docs, labels))
    assert G.reading_levels(docs.limit(0), labels).count() == 0


def test_counts_of_each_kind(spark):
    docs, labels, _ = tables(spark)
    prose = G.graded_prose(docs, labels)
    counts = grams.count_trigrams(prose.select("sentences", "grade", "fold"), lambda grade, fold: 2 * grams.FOLDS if grade > 4 else fold)
    want = Counter()
    for r in prose.collect():
        for s in r["sentences"]:
            p = q = ""
            for w in s.split(" "):
                want[grams.word_hash(p), grams.word_hash(q), grams.word_hash(w), 8 if r["grade"] > 4 else r["fold"]] += 1
                p, q = q, w
    got = {(r["p"], r["q"], r["w"], k): r[f"c{k}"] for r in counts.collect() for k in range(9) if r[f"c{k}"]}
    assert got == want


def test_pools_of_ranges_are_those_of_all(spark):
    rows = [(float((k * 37) % 101) / 7, float(1 + (k * 11) % 9) / 2 + (k * 37 % 101) / 40) for k in range(400)]
    df = spark.createDataFrame([*rows, (None, 3.0)], "score double, grade double").repartition(7)
    got, want = G.isotonic_steps(df), G.isotonic(rows)
    assert len(got) == len(want) > 1 and all(a == pytest.approx(b) for a, b in zip(got, want))


def test_parts_and_endless_sentences(monkeypatch):
    texts = [G.prose_sentences(text(HARD if k % 2 else EASY, k, 9)) for k in range(12)]
    texts[3], texts[8] = [], [[w for s in texts[8] for w in s]]
    fit = BruteForce([(s, 2 + 3 * (k % 2)) for k, s in enumerate(texts) if s])
    rows = Counter()
    for k, sents in enumerate(texts):
        for s in sents:
            rows.update((("", "", *s)[i : i + 3], k % 2) for i in range(len(s)))
    fit.train([(s, 2 + 3 * (k % 2)) for k, s in enumerate(texts)])
    keys = sorted({g for g, _ in rows})
    none = [0] * len(keys)
    cols = {c: [grams.word_hash(g[i]) for g in keys] for i, c in enumerate("pqw")} | {f"c{k}": none for k in range(9)}
    cols |= {"c1": [rows[g, 0] for g in keys], "c6": [rows[g, 1] for g in keys]}
    model = grams.Counts(pa.table(cols), fit.size).model()
    asked = [*texts, [["never", "seen"], ["the", "unknown", "box"]], []]
    for most in (grams.CHUNK, 25, 1):  # texts end within, at and after parts
        monkeypatch.setattr(grams, "CHUNK", most)
        got = list(model.distributions(asked))
        assert len(got) == len(asked)
        for g, s in zip(got, asked):
            assert [n for _, n in g] == [len(x) for x in s] and [x for x, _ in g] == pytest.approx([x for x, _ in fit.distribution(s)], abs=1e-9)
    p, q, w, hashes, _ = grams._coded([s for t in texts for s in t])
    want = grams._distinct(p, q, w, len(hashes))
    monkeypatch.setattr(grams, "MAX_VOCABULARY", 3)
    got = grams._distinct(p, q, w, len(hashes))
    assert all((a == b).all() for a, b in zip(got, want)) and (got[0][got[3]] == p).all() and (got[2][got[3]] == w).all()
