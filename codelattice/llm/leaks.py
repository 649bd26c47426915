"""Evaluation items that leaked, wholly or partly, into a corpus.

Template canonicalisation: texts become words without case, punctuation, markup and layout,
with look-alike characters folded; numbers, names (capitalised within a sentence, or written
like identifiers) and measures become typed placeholders. A template window begins at every
word and holds five words at least, three of them plain; so every place of an item that plain
words follow is indexed, however many slots it has. Windows of the words as they are stand
beside these, since a changed letter case hides names.

Windows of documents are hash-joined with those of the items. A bit mask of fixed size keeps
windows that no item has out of the join, so of a corpus only candidates move: documents with
three windows of the mask at least, each distinct text once, however many copies it has. For
each document and item that share three windows the words are aligned around these, slots are
compared with the values they hold, and a stretch of at least 18 words of the item with few
changed, dropped or added words is a leak. A slot filled anew in a consistent way (the same
old value always gives the same new one, and no other) is one change for a repeated passage,
and none for a re-parameterised one; any other counts each time.

Nothing of items or documents reaches the driver but the mask. Joins are sharded by measured
load, so a window or a text that a third of all documents share is no hot spot. There is no
cap on the items of a document or the documents of an item.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions.mask import MASK_BITS, packed_mask
from codelattice.llm.batches import map_rows
from codelattice.operators.skew import heavy_shards, sharded_join
from codelattice.session import cut, ship

WINDOW = 5  # words of a shared window at least: 18 words with two changes hold an unchanged run of at least six
PLAIN = 3  # of them that are no placeholders
SHARED = 3  # windows that a repeated passage of LEAST words keeps at least, changes allowed for
LEAST = 18  # words of the item that have to be repeated
SLACK = 0.12  # share of changed, dropped and added words that a repeated passage may have
GAP = LEAST  # words between two aligned runs of one passage at most, and beyond the outermost ones: changes may leave that many without a window
KNOWN = 400_000  # words a task remembers

_TAG = re.compile(r"</?(?:a|b|i|u|s|p|q|em|br|hr|li|ol|ul|dl|dt|dd|td|th|tr|h[1-6]|pre|sub|sup|div|tt|kbd|del|ins|code|span|font|mark|small|strong|table|tbody|thead|blockquote|details|summary|section|article|img|abbr|cite|samp|var|center)\b[^<>]{0,300}>", re.I)
_LINK = re.compile(r"\]\((?:https?:|\.{0,2}/|#|www\.)[^()\s]*\)")
_LINE_NO = re.compile(r"^[ \t>|*#/-]*(?:[Ll](?:ine[ \t]*)?)?\d{1,5}[ \t]*[.):|]?[ \t]+(?=\S)", re.M)
_PIECE = re.compile(r"\w+(?:[-'’‐‑]\w+)*|[.!?:](?=\s)|\n[ \t]*\n")  # words, and marks after which a sentence begins
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\u180e\ufe00-\ufe0f]+")
_COMBINING = re.compile("[\u0300-\u036f]")
# Letters of other scripts that look like Latin ones, and hyphens.
_LOOK = str.maketrans(
    "АВЕЅІЈКМНОРСТУХ" + "аеорсухіјѕԁһӏԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "αικνορτυχ" + "‐‑",
    "ABESIJKMHOPCTYX" + "aeopcyxijsdhlqw" + "ABEZHIKMNOPTYX" + "aikvoptux" + "--",
)
_CAMEL = re.compile(r"[a-z0-9][A-Z]|_")
_UNITS = frozenset("ms s sec secs second seconds min minute minutes h hour hours day days week weeks month months year years b kb mb gb tb kib mib gib byte bytes bit bits px em pt hz khz mhz ghz cm mm m km kg g mg l ml usd eur dollar dollars euro euros cent cents percent".split())
_NUMBER = re.compile(r"[+-]?(?:0x[0-9a-f]+|\d[\d_]*(?:[a-z]{1,3})?)", re.I)

PLAINWORD, NUMBER, UNIT, NAME, FIRST = ".nuNf"  # FIRST: a capital where a sentence begins, plain in windows, perhaps a name in slots


class Vocabulary:
    """Words a task has met, with their folded form, kinds and hashes."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.low: list[str] = []
        self.plain, self.mid, self.first, self.skip = (np.zeros(1 << 12, dtype=d) for d in (np.uint64, np.uint8, np.uint8, bool))

    def add(self, w: str) -> None:
        k = len(self.low)
        if k == len(self.plain):
            self.plain, self.mid, self.first, self.skip = (np.concatenate([a, np.zeros_like(a)]) for a in (self.plain, self.mid, self.first, self.skip))
        self.ids[w] = k
        if not w.isascii():
            w = plain_letters(w)
        word = w.strip("_").lower()
        self.low.append(word)
        self.skip[k] = re.match(r"\w", word) is None
        kind = NUMBER if _NUMBER.fullmatch(w) else UNIT if word in _UNITS else NAME if _CAMEL.search(w) else PLAINWORD
        capital = kind == PLAINWORD and w[:1].isupper()
        self.mid[k], self.first[k] = map(ord, (NAME, FIRST) if capital and len(w) > 1 else (kind, kind))
        self.plain[k] = _hash64(word)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of a folded text, and their kinds in place."""
        pieces = _PIECE.findall(text)
        if len(self.low) > KNOWN:
            self.__init__()
        ids = list(map(self.ids.get, pieces))
        if None in ids:
            for w in pieces:
                if w not in self.ids:
                    self.add(w)
            ids = list(map(self.ids.get, pieces))
        at = np.array(ids, dtype=np.int64)
        marks = self.skip[at]
        begins = np.empty(len(at), dtype=bool)
        begins[:1] = True
        begins[1:] = marks[:-1]
        kinds = np.where(begins, self.first[at], self.mid[at])
        return at[~marks], kinds[~marks]



def _hash64(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")


_SLOT = {k: np.uint64(_hash64(f"<{k}>")) for k in (NUMBER, UNIT, NAME)}
_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, b in enumerate((_B, _BINV)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _window_hashes(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    x = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(plain: np.ndarray, kinds: np.ndarray, templates: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of each window: of five words as they are, and, with ``templates``, of templates that hold a slot."""
    n = len(plain)
    if n < WINDOW:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    begin = np.arange(n - WINDOW + 1)
    found = [(_window_hashes(plain, begin, begin + WINDOW), begin, begin + WINDOW)]
    slot = (kinds == ord(NUMBER)) | (kinds == ord(UNIT)) | (kinds == ord(NAME))
    if templates and slot.any():
        typed = plain.copy()
        for k, v in _SLOT.items():
            typed[kinds == ord(k)] = v
        before = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(~slot, out=before[1:])
        places = np.flatnonzero(~slot)
        begin = begin[before[begin] + PLAIN <= len(places)]
        end = np.maximum(begin + WINDOW, places[before[begin] + PLAIN - 1] + 1) if len(begin) else begin
        held = (end - begin) > before[end] - before[begin]
        begin, end = begin[held], end[held]
        found.append((_window_hashes(typed, begin, end) ^ np.uint64(1), begin, end))
    return tuple(np.concatenate(c) for c in zip(*found))


def fold(text: str) -> str:
    """A text without markup, links, line numbers and invisible characters."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = unescape(text)
    text = _LINE_NO.sub("", text)  # numbered lines and lists are layout
    if "](" in text:
        text = _LINK.sub("]", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if _COMBINING.search(text):
            text = unicodedata.normalize("NFC", text)
    return text


def plain_letters(word: str) -> str:
    """A word in its compatible form, without accents, look-alike letters as Latin ones."""
    word = unicodedata.normalize("NFKC", word.translate(_LOOK))
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).translate(_LOOK)


def words(text: str, v: Vocabulary | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of a text, folded, and a letter for the kind of each."""
    v = v or Vocabulary()
    at, kinds = v.read(fold(text))
    return v.plain[at], kinds


def told(w: np.ndarray, kinds: np.ndarray) -> tuple[bytes, bytes]:
    """Hashes and kinds as bytes, to be moved between tasks."""
    return w.tobytes(), kinds.tobytes()


def heard(w: bytes, kinds: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(w, dtype=np.uint64), np.frombuffer(kinds, dtype=np.uint8)


# ---- alignment of a document's words with an item's -------------------------------------


def passages(w: np.ndarray, t: np.ndarray, iw: np.ndarray, it: np.ndarray, hits: list[tuple[int, int, int]], refills: bool = True) -> tuple[int, int]:
    """Words of the item in the longest passage that document words ``w`` of kinds ``t`` repeat, and in the longest one
    whose consistently refilled slots are no changes (not sought without ``refills``); 0 where a cheap test rules LEAST words out.

    Words are hashes, kinds bytes; ``hits`` are the shared windows: place in the document, place in the item, length.
    Without ``refills`` the first passage of LEAST words is enough.
    """
    repeat, refill = _may(w, t, iw, it, hits, refills)
    if not repeat and not refill:
        return 0, 0
    lists = w.tolist(), t.tobytes().decode(), iw.tolist(), it.tobytes().decode()
    repeated = _longest(*lists, hits, False, len(iw) if refills else LEAST) if repeat else 0
    if repeated >= LEAST or not refill:
        return repeated, repeated
    return repeated, max(repeated, _longest(*lists, hits, True, len(iw)))


def near_groups(hits: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Hits ``(diagonal, place in the item, length)`` in groups of neighbouring diagonals that hold SHARED windows of the item at least."""
    hits = sorted((p - j, j, n) for p, j, n in hits)
    if hits[-1][0] - hits[0][0] <= NEAR:
        return [hits] if len({j for _, j, _ in hits}) >= SHARED else []
    out, group = [], []
    for h in hits:
        if group and h[0] - group[-1][0] > NEAR:
            out.append(group)
            group = []
        group.append(h)
    out.append(group)
    return [g for g in out if len({j for _, j, _ in g}) >= SHARED]


def _may(w, t, iw, it, hits, refills) -> tuple[bool, bool]:
    """Whether LEAST words of the item may be repeated, and whether they may be with refilled slots.

    Needed for a leak, and cheap: the words of a passage lie near the diagonals of its shared
    windows, and those that are found nowhere near their place are changes, of which a stretch has
    few enough. Values of slots that are not found count once each for a repeated passage, and not
    at all for a refilled one. More than LEAST words beyond the outermost windows only make a stretch
    worse: there are no five of them without a change.
    """
    repeat = refill = False
    for group in near_groups(hits):
        lo, hi = group[0][0] - NEAR, group[-1][0] + NEAR
        a, b = max(0, min(j for _, j, _ in group) - LEAST), min(len(iw), max(j + n for _, j, n in group) + LEAST)
        if b - a < LEAST:
            continue
        asked = iw[a:b]
        gone = ~(_around(w, a + lo, b - a, hi - lo + 1) == asked[:, None]).any(axis=1)
        kind = _CLASS[it[a:b]]
        cost = np.where(gone & (kind == 0), 1.0, 0.0)
        if not _stretch(cost):
            continue
        slot = gone & (kind > 0)
        if slot.any():
            like = (_around(_CLASS[t], a + lo, b - a, hi - lo + 1) == kind[:, None]).any(axis=1)
            cost[slot & ~like] = 1.0
            slot &= like
            refill = refill or refills and slot.any() and _stretch(cost)
            met = set()
            for k in np.flatnonzero(slot).tolist():
                if (x := int(asked[k])) not in met:
                    met.add(x)
                    cost[k] = 1.0
        repeat = repeat or _stretch(cost)
        if repeat and (refill or not refills):
            break
    return repeat, refill


def _around(x: np.ndarray, start: int, n: int, width: int) -> np.ndarray:
    """``n`` windows of ``width`` of ``x`` from ``start`` on, zeros where they reach over its ends."""
    end = start + n + width - 1
    out = np.zeros(end - start, dtype=x.dtype)
    p, q = max(0, start), min(len(x), end)
    if p < q:
        out[p - start : q - start] = x[p:q]
    return out[np.arange(n)[:, None] + np.arange(width)]


def _stretch(cost: np.ndarray) -> bool:
    """Whether some LEAST or more words in a row have few enough changes."""
    sums = np.zeros(len(cost) + 1)
    np.cumsum(cost - SLACK, out=sums[1:])
    return bool((sums[LEAST:] - np.maximum.accumulate(sums[: len(sums) - LEAST]) <= 0.5 + 1e-9).any())


NEAR = 8  # words by which changes may shift a passage
_CLASS = np.zeros(256, dtype=np.uint8)  # kinds that can fill each other's slots
_CLASS[[ord(NUMBER), ord(UNIT), ord(NAME), ord(FIRST)]] = 1, 2, 3, 3


def _longest(w, t, iw, it, hits, free, enough) -> int:
    """Runs of shared windows are chained in order; the words between two runs are aligned by
    edit distance, and so are the words before the first and after the last one."""
    runs = []
    for d in {p - j for p, j, _ in hits}:
        at = sorted((j, j + n) for p, j, n in hits if p - j == d)
        start, end, prev = *at[0], at[0][0]
        for j, e in at[1:]:
            if j - prev > WINDOW and j > end:
                runs.append((start, end, d))
                start, end = j, e
            end, prev = max(end, e), j
        runs.append((start, end, d))
    runs.sort()
    best, done = 0, set()
    for k, first in enumerate(runs):
        if first in done:
            continue
        chain, last = [first], first
        for r in runs[k + 1 :]:
            gap_i, gap_d = r[0] - last[1], (r[0] + r[2]) - (last[1] + last[2])
            if gap_i > GAP:
                break
            if -WINDOW < gap_i and -WINDOW < gap_d <= GAP and r[1] > last[1] and r[1] + r[2] > last[1] + last[2]:
                chain.append(r)
                last = r
        done.update(chain)
        best = max(best, _passage(w, t, iw, it, chain, free))
        if best >= enough:
            break
    return best


def _passage(w, t, iw, it, chain, free) -> int:
    """The best of a near and a far reach: far words that match by chance can spoil the alignment of the ends."""
    near = _aligned(w, t, iw, it, chain, LEAST // 2, free)
    return near if near >= LEAST else max(near, _aligned(w, t, iw, it, chain, GAP, free))


def _aligned(w, t, iw, it, chain, reach, free) -> int:
    j0, p0 = chain[0][0], chain[0][0] + chain[0][2]
    j1, p1 = chain[-1][1], chain[-1][1] + chain[-1][2]
    a, b = max(0, j0 - reach), min(len(iw), j1 + reach)
    steps = _align(iw[a:b], it[a:b], w[max(0, p0 - reach - 2) : p1 + reach + 2], t[max(0, p0 - reach - 2) : p1 + reach + 2])
    return _best_stretch(steps, free)


def _align(iw, it, w, t) -> list[tuple]:
    """Global alignment, document ends free: a list of (op, item word, document word), op one of = v s d a; v is a slot."""
    n, m = len(iw), len(w)
    rows = [[0] * (m + 1)]  # the document may begin anywhere
    for i in range(1, n + 1):
        prev, x = rows[-1], iw[i - 1]
        cur = [i]
        for j in range(1, m + 1):
            c = prev[j - 1] + (x != w[j - 1])
            c = min(c, prev[j] + 1, cur[-1] + 1)
            cur.append(c)
        rows.append(cur)
    i, j = n, min(range(m + 1), key=lambda c: rows[n][c])
    out = []
    while i > 0:
        if j > 0 and rows[i][j] == rows[i - 1][j - 1] + (iw[i - 1] != w[j - 1]):
            same, x, y = iw[i - 1] == w[j - 1], it[i - 1], t[j - 1]
            slot = not same and (x == y and x in "nuN" or x in "Nf" and y in "Nf")
            out.append(("=" if same else "v" if slot else "s", iw[i - 1], w[j - 1]))
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + 1:
            out.append(("d", iw[i - 1], ""))
            i -= 1
        else:
            out.append(("a", "", w[j - 1]))
            j -= 1
    return out[::-1]


def _best_stretch(steps: list[tuple], free: bool) -> int:
    """Item words of the longest stretch that begins and ends with equal words and has few enough changes.

    With ``free`` a slot is no change if its value is replaced in one way wherever it stands in the
    whole alignment, and at least half of the words have to be equal.
    """
    to, of = defaultdict(set), defaultdict(set)
    if free:
        for op, a, b in steps:
            if op in "=v":
                to[a].add(b)
                of[b].add(a)
    edge = [k for k, s in enumerate(steps) if s[0] == "="]
    best = 0
    for x in range(len(edge)):
        if edge[-1] + 1 - edge[x] <= best:
            break
        cost, size, equal, slots, back = 0, 0, 0, {}, {}
        for k in range(edge[x], len(steps)):
            op, a, b = steps[k]
            size += op != "a"
            if op == "v" and free:
                cost += len(to[a]) > 1 or len(of[b]) > 1
            elif op == "v":  # filled anew in one way it is one change however often it comes
                cost += slots.get(a) != b or back.get(b) != a
                slots.setdefault(a, b)
                back.setdefault(b, a)
            elif op != "=":
                cost += 1
            else:
                equal += 1
                if size > best and cost <= SLACK * size + 0.5 and (not free or 2 * equal >= size):
                    best = size
    return best


# ---- tables ----------------------------------------------------------------------------


def item_words(items: DataFrame) -> DataFrame:
    """``item_id, words, kinds`` of each item, its leading line cut off if items that go on differently share it."""

    def make():
        v = Vocabulary()

        def ends(t):
            head, nl, tail = t.strip().partition("\n")
            return (words(head, v)[0].tobytes(), words(tail, v)[0].tobytes()) if nl else (None, None)

        def run(ids, texts):
            rows = [(i, *told(*words(t, v)), *told(*words(t.strip().partition("\n")[2], v)), *ends(t)) for i, t in zip(ids, texts)]
            return list(map(list, zip(*rows))) if rows else [[] for _ in range(7)]

        return run

    rows = items.where("text is not null and item_id is not null").select("item_id", "text")
    rows = cut(map_rows(rows, make, "item_id bigint, words binary, kinds binary, tail binary, tail_kinds binary, head binary, rest binary"))
    heads = cut(rows.where("head is not null").groupBy("head").agg(F.count_distinct("rest").alias("ways"), F.count("*").alias("n")))
    shared = heads.where("ways > 1").select("head", F.lit(True).alias("shared"))
    rows = sharded_join(rows, shared, ["head"], heavy_shards(heads.select("head", "n"), ["head"]), F.col("item_id"), "left")
    pick = lambda a, b: F.when(F.col("shared"), F.col(b)).otherwise(F.col(a))
    return rows.select("item_id", pick("words", "tail").alias("words"), pick("kinds", "tail_kinds").alias("kinds"))


def item_windows(items: DataFrame, templates: bool = True) -> DataFrame:
    """``h, item_id, j, n``: the windows of the words of ``items(item_id, words, kinds)``."""

    def make():
        def run(ids, texts, kinds):
            out = []
            for i, *wk in zip(ids, texts, kinds):
                h, b, e = windows(*heard(*wk), templates)
                out += [(x, i, int(p), int(q - p)) for x, p, q in zip(h.view(np.int64).tolist(), b, e)]
            return list(map(list, zip(*out))) if out else [[] for _ in range(4)]

        return run

    return map_rows(items, make, "h bigint, item_id bigint, j int, n int")


def candidates(documents: DataFrame, item_w: DataFrame, templates: bool = True) -> DataFrame:
    """``doc_id, text_id, words, kinds, h, p`` (hash and place of each window) of the documents with SHARED windows that may be an item's; equal words have one ``text_id``."""
    sent = documents.sparkSession.sparkContext.broadcast(packed_mask(item_w))  # 2^MASK_BITS bits

    def make():
        mask, v = sent.value, Vocabulary()
        low = np.uint64((1 << MASK_BITS) - 1)

        def run(ids, texts):
            out = []
            for d, text in zip(ids, texts):
                if not text:
                    continue
                at, kinds = v.read(fold(text))
                if len(at) < LEAST * (1 - SLACK) - 1:
                    continue
                hashes = v.plain[at]
                h, begin, _ = windows(hashes, kinds, templates)
                bit = h & low
                seen = (mask[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)
                k = np.flatnonzero(seen)
                if len(k) >= SHARED:
                    w, c = told(hashes, kinds)
                    key = hashlib.blake2b(w + c, digest_size=16).digest()
                    out.append((d, key, w, c, h[k].view(np.int64), begin[k].astype(np.int32)))
            return list(map(list, zip(*out))) if out else [[] for _ in range(6)]

        return run

    schema = "doc_id bigint, text_id binary, words binary, kinds binary, h array<bigint>, p array<int>"
    return map_rows(documents.select("doc_id", "text"), make, schema)


def leaks(documents: DataFrame, items: DataFrame, templates: bool = True, refills: bool = True) -> DataFrame:
    """``doc_id, item_id, repeated, refilled``: words of the longest passage of the item that the document repeats, and
    of the longest one with consistently refilled slots taken for equal (the same without ``refills``); one of them is LEAST at least.

    Null and blank texts repeat nothing; repeated documents count each, so a ``doc_id`` that comes
    twice gives its rows twice. Items shorter than the least passage cannot leak; without items
    there is no row. ``templates`` off leaves typed windows out, for comparison.
    """
    items = cut(item_words(items))
    item_w = cut(item_windows(items, templates))
    docs = cut(candidates(documents, item_w, templates))
    texts = docs.groupBy("text_id").agg(F.first(F.struct("words", "kinds", "h", "p")).alias("_t"), F.count("*").alias("n"))
    texts = cut(texts.select("text_id", "_t.*", "n"))
    hits = texts.select("text_id", F.explode(F.arrays_zip("h", "p")).alias("_h")).select("text_id", "_h.h", "_h.p")
    load = cut(hits.groupBy("h").agg(F.count("*").alias("n")))
    met = sharded_join(hits, item_w, ["h"], heavy_shards(load, ["h"]), F.xxhash64("text_id", "p"))
    place = F.array(F.col("p") - F.col("j"), F.col("p"), F.col("j"), F.col("n"))
    pairs = met.groupBy("text_id", "item_id").agg(F.array_sort(F.collect_list(place)).alias("at"))  # places of one text
    close = F.exists(F.sequence(F.lit(SHARED), F.size("at")), lambda i: F.element_at("at", i)[0] - F.element_at("at", i - SHARED + 1)[0] <= (SHARED - 1) * NEAR)
    pairs = cut(pairs.where(F.size("at") >= SHARED).where(close))
    load = cut(pairs.groupBy("item_id").agg(F.count("*").alias("n")))
    asked = sharded_join(pairs, items, ["item_id"], heavy_shards(load, ["item_id"]), F.col("text_id"))
    rows = asked.groupBy("text_id").agg(F.collect_list(F.struct("item_id", "words", "kinds", F.flatten("at").alias("at"))).alias("asked"))  # items of one text
    rows = rows.join(texts.select("text_id", "words", "kinds"), "text_id")

    def verify(batches):
        for b in batches:
            keys, ws, ks, lists = b.column("text_id"), b.column("words"), b.column("kinds"), b.column("asked")
            items = lists.flatten()
            ids, iws, iks, places = (items.field(k) for k in range(4))
            ends, at = places.offsets.to_numpy(), places.values.to_numpy().reshape(-1, 4)[:, 1:]
            ids, ends, out, k = ids.to_pylist(), ends // 4, [], 0
            for row, n in enumerate(lists.value_lengths().to_pylist()):
                wk = heard(ws[row].as_py(), ks[row].as_py())
                for k in range(k, k + n):
                    r, f = passages(*wk, *heard(iws[k].as_py(), iks[k].as_py()), at[ends[k] : ends[k + 1]].tolist(), refills)
                    if f >= LEAST:
                        out.append((keys[row].as_py(), ids[k], r, f))
                k += n > 0
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), found)] if out else [pa.array([], f.type) for f in found], schema=found)

    found = pa.schema([("text_id", pa.binary()), ("item_id", pa.int64()), ("repeated", pa.int32()), ("refilled", pa.int32())])
    ship(docs.sparkSession)
    told = rows.select("text_id", "asked", "words", "kinds").mapInArrow(verify, "text_id binary, item_id bigint, repeated int, refilled int")
    told = told.groupBy("text_id", "item_id").agg(F.max("repeated").alias("repeated"), F.max("refilled").alias("refilled"))
    copies = heavy_shards(texts.select("text_id", "n"), ["text_id"])
    return sharded_join(docs.select("doc_id", "text_id"), told, ["text_id"], copies, F.col("doc_id")).drop("text_id")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``: one row per document row and item of which it repeats a passage (see ``leaks``)."""
    return leaks(documents, items, refills=False).select("doc_id", "item_id")


def reparameterised_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, words``: items that a document holds with other values in their slots, each value replaced in one way, and does not repeat."""
    return leaks(documents, items).where((F.col("repeated") < LEAST) & (F.col("refilled") >= LEAST)).select("doc_id", "item_id", F.col("refilled").alias("words"))
