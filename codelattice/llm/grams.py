"""Counts of word trigrams over whole tables, and interpolated models of two kinds of text.

Every trigram of every text counts. Counts are made where the texts are, combined and added
up by trigram; words stand for themselves as 64-bit hashes. If all counts are at most
MAX_TRIGRAMS rows they are held as sorted arrays and sent to the tasks (``Counts``, ``Model``);
beyond that nothing of them leaves the cluster and trigrams meet their counts in joins
(``joined_values``). Both give the same values: those of interpolated word trigram models with Witten-Bell weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.operators.skew import heavy_shards, sharded_join
from codelattice.session import cut, ship

MAX_TRIGRAMS = 2_000_000  # distinct trigrams that are held in memory, 56 bytes each; more are joined
MAX_VOCABULARY = 2_000_000  # three ids of words fit one 64-bit key
FOLDS = 4
BOUND = 4.0  # bits per word beyond which a sentence's difference counts no more
CHUNK = 200_000  # words that are counted or scored at once
_MEMO = 300_000  # words whose id a task remembers
_KINDS = 2 * FOLDS + 1  # easy and demanding per fold, then words of texts that are in neither model
_COUNTS = [f"c{k}" for k in range(_KINDS)]

Sentences = list[list[str]]


def word_hash(w: str) -> int:
    return int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little", signed=True)


def map_parts(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """As ``batches.map_rows``, but the function yields any number of parts for a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for cols in f(*[b.column(n).to_pylist() for n in names]):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, out)], schema=out)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def parts_of(items: Iterable[tuple[Sentences, object]]) -> Iterator[list[tuple[Sentences, object]]]:
    """The items in lists of about CHUNK words; a longer text comes in several."""
    held, n = [], 0
    for sentences, tag in items:
        part: Sentences = []
        for s in sentences:
            part.append(s)
            n += len(s)
            if n >= CHUNK:
                yield [*held, (part, tag)]
                held, part, n = [], [], 0
        if part:
            held.append((part, tag))
    if held:
        yield held


def trigrams(ids: np.ndarray, lengths: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of the sentences the two words before it, and where sentences start."""
    starts = np.cumsum(lengths) - lengths
    q = np.roll(ids, 1)
    q[starts] = begin
    p = np.roll(q, 1)
    p[starts] = begin
    return p, q, starts


def _coded(sentences: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``p, q, w`` as numbers of the words of these sentences, their hashes by number, and the lengths."""
    number: dict[str, int] = {"": 0}
    w = np.array([number.setdefault(x, len(number)) for s in sentences for x in s], np.int64)
    lengths = np.array([len(s) for s in sentences], np.int64)
    p, q, _ = trigrams(w, lengths, 0)
    return p, q, w, np.array([word_hash(x) for x in number], np.int64), lengths


def _distinct(p: np.ndarray, q: np.ndarray, w: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams of numbers below ``v``, and of each given one its place among them."""
    pairs, known = p * v + q, None
    if v > MAX_VOCABULARY:  # one endless sentence may hold as many words
        known, pairs = np.unique(pairs, return_inverse=True)
    keys, at = np.unique(pairs * v + w, return_inverse=True)
    pairs = keys // v if known is None else known[keys // v]
    return pairs // v, pairs % v, keys % v, at


def count_trigrams(texts: DataFrame, kind: Callable[..., int]) -> DataFrame:
    """``p, q, w, c0 .. c8``: how often each trigram occurs in the ``sentences`` of each kind of text.

    ``kind`` gives the kind of a row from its other columns; it is a fold's easy or demanding part, or the last for neither.
    """
    others = [c for c in texts.columns if c != "sentences"]

    def make():
        def run(sentences, *rest):
            items = (([x.split(" ") for x in s], kind(*r)) for s, *r in zip(sentences, *rest))
            for part in parts_of(items):
                p, q, w, hashes, _ = _coded([s for sents, _ in part for s in sents])
                kinds = np.repeat([k for _, k in part], [sum(map(len, sents)) for sents, _ in part])
                p, q, w, at = _distinct(p, q, w, len(hashes))
                n = np.bincount(at * _KINDS + kinds, minlength=len(p) * _KINDS).reshape(-1, _KINDS)
                yield hashes[p], hashes[q], hashes[w], *n.T.astype(np.int64)

        return run

    schema = "p bigint, q bigint, w bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    rows = map_parts(texts.select("sentences", *others), make, schema)
    return rows.groupBy("p", "q", "w").agg(*[F.sum(c).alias(c) for c in _COUNTS])


class _Ids(dict):
    """Ids of words by their hashes; the number of known words for any other."""

    def __init__(self, words: np.ndarray):
        super().__init__()
        self.words = words

    def __missing__(self, w: str) -> int:
        h = word_hash(w)
        k = int(np.searchsorted(self.words, h))
        k = k if k < len(self.words) and self.words[k] == h else len(self.words)
        if len(self) < _MEMO:
            self[w] = k
        return k


class Counts:
    """All counts as sorted arrays; ``model`` leaves out a fold, or none."""

    def __init__(self, table: pa.Table, size: int):
        self.size = size
        kinds = [np.unique(table.column(c).to_numpy()) for c in "pqw"]
        self.words = np.unique(np.concatenate([*kinds, [word_hash("")]]))
        v = len(self.words) + 1
        key = np.zeros(len(table), np.int64)
        for c in "pqw":
            key *= v
            key += np.searchsorted(self.words, table.column(c).to_numpy())
        order = np.argsort(key)
        self.key = key[order]
        self.counts = []
        for c in _COUNTS[: 2 * FOLDS]:
            n = table.column(c).to_numpy()
            self.counts.append(n.astype(np.min_scalar_type(int(n.max(initial=0))))[order])  # most are small

    def model(self, without: int | None = None) -> Model:
        sides = []
        for side in range(2):
            n = np.zeros(len(self.key), np.int64)
            for f in range(FOLDS):
                if f != without:
                    n += self.counts[side * FOLDS + f]
            sides.append(n)
        return Model(self.words, self.key, sides, self.size)


class _Side:
    """Interpolated trigram model over sorted keys, for many trigrams at once."""

    def __init__(self, v: int, key: np.ndarray, n: np.ndarray, size: int):
        some = n > 0
        key, n = key[some], n[some]
        n1 = np.bincount(key % v, n, v)
        total, kinds = float(n.sum()), int((n1 > 0).sum())
        self.x1 = (n1 + kinds / size) / (total + kinds) if len(n) else np.full(v, 1 / size)
        self.key2, at = np.unique(key % (v * v), return_inverse=True)
        self.n2 = np.bincount(at, n, len(self.key2))
        self.c2, self.k2 = np.bincount(self.key2 // v, self.n2, v), np.bincount(self.key2 // v, minlength=v)
        self.key3, at = np.unique(key // v, return_inverse=True)
        self.c3, self.k3 = np.bincount(at, n, len(self.key3)), np.bincount(at, minlength=len(self.key3))

    def bits(self, v: int, key: np.ndarray, n3: np.ndarray | int) -> np.ndarray:
        x = self.x1[key % v]
        (n2,) = _found(self.key2, key % (v * v), self.n2)
        q = key // v % v
        c, k = self.c2[q], self.k2[q]
        x = np.where(c > 0, (n2 + k * x) / np.maximum(c + k, 1), x)
        c, k = _found(self.key3, key // v, self.c3, self.k3)
        return -np.log2(np.where(c > 0, (n3 + k * x) / np.maximum(c + k, 1), x))


def _found(keys: np.ndarray, asked: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values of the asked keys, 0 for those that are not there."""
    if not len(keys):
        return [np.zeros(len(asked), x.dtype) for x in values]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    there = keys[at] == asked
    return [np.where(there, x[at], 0) for x in values]


class Model:
    """Difference of surprisal, easy model less demanding model, of any sentence."""

    def __init__(self, words: np.ndarray, key: np.ndarray, sides: list[np.ndarray], size: int):
        self.words, self.v, self.ids = words, len(words) + 1, None
        some = sides[0] + sides[1] > 0
        self.key = key[some]
        self.sides = [_Side(self.v, key, n, size) for n in sides]
        self.d = np.empty(len(self.key))
        n3 = [n[some] for n in sides]
        for at in range(0, len(self.key), CHUNK):
            part = slice(at, at + CHUNK)
            easy, hard = (x.bits(self.v, self.key[part], n[part]) for x, n in zip(self.sides, n3))
            self.d[part] = easy - hard

    def __getstate__(self):
        return {**self.__dict__, "ids": None}

    def differences(self, key: np.ndarray) -> np.ndarray:
        easy, hard = self.sides
        if not len(self.key):
            return easy.bits(self.v, key, 0) - hard.bits(self.v, key, 0)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        out = self.d[at]
        new = np.flatnonzero(self.key[at] != key)
        if len(new):
            out[new] = easy.bits(self.v, key[new], 0) - hard.bits(self.v, key[new], 0)
        return out

    def distributions(self, texts: Iterable[Sentences]) -> Iterator[list[tuple[float, int]]]:
        """Of each text the bounded mean difference of each sentence, and its words."""
        if self.ids is None:
            self.ids = _Ids(self.words)
        done = 0  # texts given out
        values: list[tuple[float, int]] = []  # of the text that comes next

        def tagged():
            nonlocal seen
            for s in texts:
                yield s, seen
                seen += 1

        seen = 0
        for part in parts_of(tagged()):
            flat = [s for sents, _ in part for s in sents]
            lengths = np.array([len(s) for s in flat], np.int64)
            w = np.array([self.ids[x] for s in flat for x in s], np.int64)
            p, q, starts = trigrams(w, lengths, self.ids[""])
            d = self.differences((p * self.v + q) * self.v + w)
            got = list(zip(np.clip(np.add.reduceat(d, starts) / lengths, -BOUND, BOUND).tolist(), lengths.tolist()))
            at = 0
            for sents, k in part:
                while done < k:  # the last of a text is known when another one begins
                    yield values
                    done, values = done + 1, []
                values += got[at : at + len(sents)]
                at += len(sents)
        while done < seen:
            yield values
            done, values = done + 1, []


def held_counts(counts: DataFrame, size: int) -> Counts | None:
    """The counts in memory if they are few enough; ``counts`` is read twice and should be materialised."""
    n, most = counts.agg(F.count("*"), F.max(F.greatest(*_COUNTS))).first()
    if n > MAX_TRIGRAMS or size >= MAX_VOCABULARY or (most or 0) >= 1 << 31:
        return None
    return Counts(counts.select("p", "q", "w", *[F.col(c).cast("int") for c in _COUNTS[: 2 * FOLDS]]).toArrow(), size)


def joined_values(texts: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """``row, values array<struct<x double, n bigint>>``: the distribution of each of ``texts(row, fold, sentences)`` with prose.

    ``fold`` is the one that the text's model is made without; null for the model of all.
    Trigrams of texts are shuffled, those that many texts hold in shards by their load.
    """
    keys = ["v", "p", "q", "w"]

    def make():
        def run(sentences, rows, folds):
            items = (([x.split(" ") for x in s], (r, FOLDS if f is None else f)) for s, r, f in zip(sentences, rows, folds))
            last, s = None, 0  # sentences are numbered on in a text of several parts
            for part in parts_of(items):
                p, q, w, hashes, lengths = _coded([s for sents, _ in part for s in sents])
                numbers = []
                for sents, (r, _) in part:
                    s = s if r == last else 0
                    numbers += range(s, s + len(sents))
                    last, s = r, s + len(sents)
                many = [sum(map(len, sents)) for sents, _ in part]
                yield (
                    np.repeat([r for _, (r, _) in part], many), np.repeat(numbers, lengths), np.repeat([v for _, (_, v) in part], many),
                    hashes[p], hashes[q], hashes[w],
                )

        return run

    words = map_parts(texts.select("sentences", "row", "fold"), make, "row bigint, s bigint, v int, p bigint, q bigint, w bigint")
    loads = cut(words.groupBy(*keys).agg(F.count("*").alias("n")))
    rows = sharded_join(words, _differences(loads.select(*keys), counts, size), keys, heavy_shards(loads, keys), F.xxhash64("row", "s"))
    x = F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.sum("d") / F.count("*")))
    each = rows.groupBy("row", "s").agg(x.alias("x"), F.count("*").alias("n"))
    return each.groupBy("row").agg(F.collect_list(F.struct("x", "n")).alias("values"))


def _differences(asked: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """``v, p, q, w, d`` of the distinct asked trigrams, under the model without fold ``v``, or of all for FOLDS."""

    def without(side: int, v: int):
        return sum((F.col(f"c{side * FOLDS + f}") for f in range(FOLDS) if f != v), F.lit(0).cast("bigint"))

    models = [F.struct(F.lit(v).alias("v"), without(0, v).alias("e"), without(1, v).alias("h")) for v in range(FOLDS + 1)]
    n3 = counts.select("p", "q", "w", F.explode(F.array(*models)).alias("m")).select("m.v", "p", "q", "w", "m.e", "m.h").where("e + h > 0")

    def sums(df: DataFrame, n: str, *by: str) -> DataFrame:
        """Per key the sum of counts and the number of kinds, as ``ce, ke, ch, kh`` with a number."""
        return df.groupBy(*by).agg(*[a for x in "eh" for a in (F.sum(x).alias(f"c{x}{n}"), F.count_if(F.col(x) > 0).alias(f"k{x}{n}"))])

    n2 = n3.groupBy("v", "q", "w").agg(F.sum("e").alias("e"), F.sum("h").alias("h"))
    n1 = n2.groupBy("v", "w").agg(F.sum("e").alias("e"), F.sum("h").alias("h"))

    def n_of(c: str):
        return F.coalesce(F.col(c), F.lit(0))

    def mixed(x: str, number: int) -> list:
        """The columns of the next longer model from those of ``x``, after the joins with its counts."""
        return [
            F.when(n_of(f"c{s}{number}") > 0, (n_of(s) + F.col(f"k{s}{number}") * F.col(f"{x}{s}")) / (F.col(f"c{s}{number}") + F.col(f"k{s}{number}")))
            .otherwise(F.col(f"{x}{s}")).alias(f"x{s}")
            for s in "eh"
        ]

    first = [
        F.when(n_of(f"c{s}1") > 0, (n_of(s) + F.col(f"k{s}1") / size) / (F.col(f"c{s}1") + F.col(f"k{s}1"))).otherwise(F.lit(1 / size)).alias(f"x{s}")
        for s in "eh"
    ]
    x1 = asked.select("v", "w").distinct().join(n1, ["v", "w"], "left").join(F.broadcast(sums(n1, "1", "v")), "v", "left").select("v", "w", *first)  # a row per model
    x2 = asked.select("v", "q", "w").distinct().join(x1, ["v", "w"]).join(sums(n2, "2", "v", "q"), ["v", "q"], "left").join(n2, ["v", "q", "w"], "left")
    x2 = x2.select("v", "q", "w", *mixed("x", 2))
    x3 = asked.join(x2, ["v", "q", "w"]).join(sums(n3, "3", "v", "p", "q"), ["v", "p", "q"], "left").join(n3, ["v", "p", "q", "w"], "left")
    return x3.select("v", "p", "q", "w", *mixed("x", 3)).select("v", "p", "q", "w", (F.log2("xh") - F.log2("xe")).alias("d"))
