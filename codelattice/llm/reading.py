"""Reading level of documents by surprisal under interpolated n-gram models.

Two word trigram models, interpolated down to words and to a uniform share for unknown ones
(Witten-Bell weights), are trained on the prose of graded documents: one on those graded
easy, one on those graded demanding. As single grades may be off, documents are first scored
by models of the other folds, and those whose grade the fit contradicts are left out of the
final training. Every
sentence of a document has a surprisal under either model; the document's score is the
distribution's mean of the bounded difference, weighted by words. Isotonic regression on the
graded documents maps scores to levels, so a higher score never gets a lower level.

Only prose counts: code, logs, tables, lists of names and links are dropped first. Whether a
text is English is judged by its own words. The models count every word of every graded
document, and the regression takes all of their scores. Documents are scored where they are
read, each by itself, by a broadcast model as long as it is small; see ``grams``.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions.mask import mask_of, may_hold
from codelattice.llm.batches import map_rows
from codelattice.llm.grams import CHUNK, FOLDS, Model, count_trigrams, held_counts, joined_values, map_parts
from codelattice.session import cut, ship

DEMANDING = 3.5  # the level from which prose is demanding: between 3 and 4
LEVELS = "doc_id bigint, level double, language string, low double, median double, high double"

# Bounds of ``graded_sample``, which no query reads.
MAX_GRADED = 1500  # graded documents, those of least hash
MAX_WORDS = 600_000  # words of these
SHARE = 100  # of a text longer than MAX_WORDS / SHARE sentences from all over it, up to that

_FENCE = re.compile(r"^[ \t>]*(`{3,}|~{3,}).*?(?:^[ \t>]*\1[ \t]*$|\Z)", re.M | re.S)
_PRE = re.compile(r"<(pre|code|script|style|table|syntaxhighlight)\b.*?(?:</\1>|\Z)", re.I | re.S)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--.*?-->", re.S)
_LINKS = re.compile(r"\]\([^()\s]*\)|<?\b(?:https?|ftp)://[^\s)>\]]+|\bwww\.[^\s)>\]]+")
_NOT_PROSE = re.compile(
    r"""^[ \t>]*(?:
      (?:\d{4}-\d\d-\d\d[T ])?\d\d:\d\d(?::\d\d)?\b.* | \[?(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b.* | \|.*\|?[ \t]* | [+\-=*_#~.:|\s]+ | (?:\#|={2,}).*
      | (?:commit|author|date|merge|subject|from|to|cc|re|names?|keywords|tags|see\ also)\b[ \t]*:?.{0,4}[0-9a-f]{7,40}.* | (?:subject|author|date|names?|keywords|tags)[ \t]*:.* | \S+\ wrote:[ \t]* | \[[^\]]*\][ \t]+step\b.*
      | \$[ \t].* | (?:at|in)\ [\w.$]+\(.*\).* | [-*+][ \t]+\S+ | (?:\S+)
    )$""",
    re.X | re.I,
)
_CODE_LINE = re.compile(r"[;{}][ \t]*$|^\s*(?:def|class|func|fn|pub|let|const|var|import|return|assert|if|for|while)\b.*[(\[{=:].*|[\w\])]\s*(?::=|==|!=|<=|>=|&&|\|\||\+=|->|=>)\s*[\w(\[]|\w\(.*\)\s*$|^\s*[\w.]+\s*=\s*\S")
#: A line that the tests above would keep: a capital, words, and a full stop, without signs of anything else.
_PLAIN = re.compile(r"(?:[-*][ \t]+)?[A-Z][a-z' ][^{}()\[\]<>|=_$:;/\\`#*]*[.!?]")
_MARK = re.compile(r"^[ \t>]*(?:[-*+]|\d+[.)])?[ \t]*")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PLAIN_TEXT = re.compile(r"(?:[A-Z]?[a-z'’-]*+[^\w`'’-]++)*+[A-Z]?[a-z'’-]*+", re.A)  # no names, digits or quoted code
_NAME = re.compile(r"\b\w*(?:[a-z0-9][A-Z]|_\w|\d)\w*\b|`[^`\n]*`")
# Frequent small words of the languages to tell apart.
_SMALL = {
    "en": frozenset("the a an and or of to in it is are was be that this with for on as not by from you we which when so has have its at if each every one no but they can there their".split()),
    "de": frozenset("der die das und oder nicht ist ein eine einen einem den dem des im in mit von zu auf für wir sie ohne damit bitte wird sind auch alle jede jeden nach zuerst danach es".split()),
    "fr": frozenset("le la les et ou ne pas est un une des du de dans avec pour sur nous vous sans que qui chaque sont aux au par se il elle en d l cette ce".split()),
    "es": frozenset("el la los las y o no es un una del de en con para por se que cada sin sobre nosotros son al lo su como antes cuando este esta".split()),
}


def prose_sentences(text: str) -> list[list[str]]:
    """The sentences of the prose of a text, as lists of lower-case words without names and numbers."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "<" in text:
        text = _TAG.sub(" ", _PRE.sub("\n", text))
    if "://" in text or "](" in text or "www." in text:
        text = _LINKS.sub(" ", text)
    out: list[list[str]] = []
    for block in re.split(r"\n[ \t>]*\n", text.replace("\r\n", "\n")):
        kept: list[str] = []
        for line in block.split("\n"):
            if _PLAIN.fullmatch(line) and " " in line:
                bullet = 0 if line[0] not in "-*" else _MARK.match(line).end()
            elif not line.strip() or _NOT_PROSE.match(line) or _CODE_LINE.search(line) or line[:4] == "    ":
                continue
            else:
                bullet = _MARK.match(line).end()
            if bullet and line[:bullet].strip(" \t>") and kept:
                out.extend(_split(" ".join(kept)))
                kept = []
            kept.append(line[bullet:])
        if kept:
            out.extend(_split(" ".join(kept)))
    return out


def _split(text: str) -> list[list[str]]:
    if not _PLAIN_TEXT.fullmatch(text):
        text = _NAME.sub(" ", text)
    return [w for w in (_WORD.findall(s.lower()) for s in _SENTENCE.split(text)) if len(w) > 1]


def language(sentences: list[list[str]]) -> str | None:
    """The language most of whose small words occur; None without any."""
    seen = Counter(w for s in sentences for w in s)
    best = max(_SMALL, key=lambda k: (sum(n for w, n in seen.items() if w in _SMALL[k]), k == "en"))
    return best if any(w in _SMALL[best] for w in seen) else None


class Level:
    """Scores of documents, by a model, and their map to levels, the steps of a regression."""

    def __init__(self, model: Model | None, steps: list[tuple[float, float]]):
        self.model, self.steps = model, steps

    def level(self, score: float) -> float:
        """Interpolated between the steps of the regression."""
        xs = [x for x, _ in self.steps]
        k = bisect_right(xs, score)
        if k == 0 or not xs:
            return self.steps[0][1] if xs else 3.0
        if k == len(xs):
            return self.steps[-1][1]
        (a, u), (b, v) = self.steps[k - 1], self.steps[k]
        return u + (v - u) * (score - a) / (b - a) if b > a else v

    def agrees(self, score: float | None, grade: float) -> bool:
        """Whether the fit puts a document on the side of the border that its grade is on."""
        return score is None or (self.level(score) > DEMANDING) == (grade >= 4)


def mean_of(values: list[tuple[float, int]]) -> float | None:
    n = sum(w for _, w in values)
    return sum(x * w for x, w in values) / n if n else None


def quantiles(values: list[tuple[float, int]], at: tuple[float, ...] = (0.1, 0.5, 0.9)) -> list[float | None]:
    """The least values below or at which that share of the words lies."""
    total, upto, out = sum(w for _, w in values), 0, []
    for x, w in sorted(values):
        upto += w
        while len(out) < len(at) and upto >= at[len(out)] * total:
            out.append(x)
    return out or [None] * len(at)


def isotonic(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Pool adjacent violators: (mean score, mean grade) of each pool, both rising."""
    return [(x / n, y / n) for x, y, n in pooled((x, y, 1) for x, y in sorted(points))]


def pooled(parts: Iterable[tuple[float, float, int]]) -> list[list[float]]:
    """Pools (score sum, grade sum, n) of parts in order of score, each a point or a pool of points.

    Pools of pools are those of their points, so each range of scores may be pooled by itself first.
    """
    pools: list[list[float]] = []
    for part in parts:
        pools.append(list(part))
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return pools


def isotonic_steps(scores: DataFrame) -> list[tuple[float, float]]:
    """``isotonic`` of the rows of ``scores(score, grade)``, null scores left out; only pools reach the driver."""

    def run(batches):
        rows = ((x, y, 1) for b in batches for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        pools = pooled(rows)
        yield pa.RecordBatch.from_pydict({"x": [p[0] for p in pools], "y": [p[1] for p in pools], "n": [p[2] for p in pools]}, pa.schema({"x": pa.float64(), "y": pa.float64(), "n": pa.int64()}))

    ship(scores.sparkSession)
    points = scores.where("score is not null").select("score", "grade").orderBy("score", "grade")
    return [(x / n, y / n) for x, y, n in pooled(tuple(r) for r in points.mapInArrow(run, "x double, y double, n bigint").collect())]


def spread_part(sentences: list[list[str]], most: int) -> list[list[str]]:
    """The sentences, or of a longer text every k-th one, with at most ``most`` words."""
    total = sum(map(len, sentences))
    if total <= most:
        return sentences
    out, n = [], 0
    for s in sentences[:: -(-total // most)]:
        out.append(s[: most - n])
        n += len(out[-1])
        if n >= most:
            break
    return out


def graded_sample(documents: DataFrame, labels: DataFrame, most: int = MAX_GRADED) -> list[tuple[list[list[str]], float]]:
    """Sentences and median grade of at most ``most`` graded English documents, those of least hash.

    For a look at the grades on one machine; no query reads it, ``fit`` takes all graded documents.
    Of a very long text only a part is taken, and a text that no longer fits MAX_WORDS is
    skipped, so at least SHARE documents are in the sample if there are as many.
    """
    each = MAX_WORDS // SHARE
    ids = (
        labels.where("doc_id is not null and level is not null").groupBy("doc_id").agg(F.percentile("level", 0.5).alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")  # at most ``most`` rows

    def make():
        def run(keys, texts, grades):
            sents = [prose_sentences(t) for t in texts]
            keep = [i for i, s in enumerate(sents) if language(s) == "en"]
            sents = [spread_part(s, each) for s in sents]
            return [keys[i] for i in keep], [[" ".join(x) for x in sents[i]] for i in keep], [grades[i] for i in keep]

        return run

    schema = "doc_id bigint, sentences array<string>, grade double"
    out, n = [], 0
    for r in map_rows(rows, make, schema).orderBy(F.xxhash64("doc_id")).limit(most).collect():
        sents = [x.split(" ") for x in r["sentences"]]
        size = sum(map(len, sents))
        if n + size > MAX_WORDS:
            continue
        n += size
        out.append((sents, r["grade"]))
    return out


def graded_prose(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``row, grade, fold, sentences`` of every graded English document row, with its median grade and whole prose.

    Copies of one text must not vouch for each other: they share a fold.
    """
    grades = labels.where("doc_id is not null and level is not null").groupBy("doc_id").agg(F.percentile("level", 0.5).alias("grade"))
    docs = may_hold(documents.select("doc_id", "text").where("text is not null"), mask_of(grades.select(F.xxhash64("doc_id").alias("h"))), F.xxhash64("doc_id"))

    def make():
        def run(texts, grades):
            kept = ((s, g) for s, g in zip(map(prose_sentences, texts), grades) if language(s) == "en")
            held, n = [], 0
            for s, g in kept:
                sents = [" ".join(x) for x in s]
                held.append((g, zlib.crc32(" ".join(sents).encode()) % FOLDS, sents))
                n += sum(map(len, s))
                if n >= CHUNK:
                    yield zip(*held)
                    held, n = [], 0
            if held:
                yield zip(*held)

        return run

    rows = map_parts(docs.join(grades, "doc_id").select("text", "grade"), make, "grade double, fold int, sentences array<string>")
    return rows.select(F.monotonically_increasing_id().alias("row"), "*")


def with_scores(graded: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """The graded rows with ``score``: under models made without their own fold."""
    held = held_counts(counts, size)
    graded = graded.select("row", "grade", "fold", "sentences")
    if held is None:
        values = joined_values(graded, counts, size)
        n = F.aggregate("values", F.lit(0).cast("bigint"), lambda a, v: a + v["n"])
        total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v["x"] * v["n"])
        return graded.join(values.select("row", (total / n).alias("score")), "row", "left")
    sent = graded.sparkSession.sparkContext.broadcast(held)  # at most MAX_TRIGRAMS rows

    def make():
        def run(*cols):
            for k in sorted(set(cols[2])):
                part = [[c[i] for i, f in enumerate(cols[2]) if f == k] for c in cols]
                values = sent.value.model(k).distributions([x.split(" ") for x in s] for s in part[3])
                yield *part, [mean_of(v) for v in values]

        return run

    return map_parts(graded, make, "row bigint, grade double, fold int, sentences array<string>, score double")


def fit(documents: DataFrame, labels: DataFrame) -> tuple[list[tuple[float, float]], DataFrame, int]:
    """The steps from scores to levels, the counts of the final models and the size of the vocabulary, from all graded documents."""
    graded, steps, size = cut(graded_prose(documents, labels)), None, None

    def kind(level: Level | None):
        def of(grade, fold, score=None):
            if (3 < grade < 4) or (level and not level.agrees(score, grade)):
                return 2 * FOLDS  # graders disagree about the border, or the fit contradicts them
            return fold + (FOLDS if grade >= 4 else 0)

        return of

    counts = cut(count_trigrams(graded.select("sentences", "grade", "fold"), kind(None)))
    size = counts.select("w").distinct().count() + 1000
    for _ in range(2):
        graded = cut(with_scores(graded, counts, size))
        steps = isotonic_steps(graded)
        counts = cut(count_trigrams(graded.select("sentences", "grade", "fold", "score"), kind(Level(None, steps))))
    return steps, counts, size


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, level, language, low, median, high`` of each document row.

    ``level`` is on the graders' scale, null unless the text is English prose; ``low`` to ``high`` are
    the tenth, fiftieth and ninetieth percent of the distribution of surprisal over its words.
    ``language`` is null for null and blank texts and for texts without prose. Repeated documents
    each count. Without grades every English text gets the middle level.
    """
    steps, counts, size = fit(documents, labels)
    held = held_counts(counts, size)
    if held is None:
        return _joined_levels(documents, steps, counts, size)
    sent = documents.sparkSession.sparkContext.broadcast(Level(held.model(), steps))  # at most MAX_TRIGRAMS rows

    def make():
        m = sent.value

        def run(ids, texts):
            langs = []

            def english():
                for t in texts:
                    sents = prose_sentences(t) if t else []
                    langs.append(language(sents))
                    yield sents if langs[-1] == "en" else []

            levels, spans = [], []
            for values in m.model.distributions(english()):
                x = mean_of(values)
                levels.append(None if x is None else m.level(x))
                spans.append(quantiles(values))
            return ids, levels, langs, *([s[k] for s in spans] for k in range(3))

        return run

    return map_rows(documents.select("doc_id", "text"), make, LEVELS)


def _joined_levels(documents: DataFrame, steps: list[tuple[float, float]], counts: DataFrame, size: int) -> DataFrame:
    """The levels where counts are too many to be held."""

    def parse():
        def run(rows, ids, texts):
            sents = [prose_sentences(t) if t else [] for t in texts]
            langs = [language(s) for s in sents]
            return rows, ids, langs, [[" ".join(x) for x in s] if k == "en" else [] for s, k in zip(sents, langs)]

        return run

    docs = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    docs = cut(map_rows(docs, parse, "row bigint, doc_id bigint, language string, sentences array<string>"))
    values = joined_values(docs.select("row", F.lit(None).cast("int").alias("fold"), "sentences"), counts, size)
    fitted = Level(None, steps)

    def make():
        def run(ids, langs, values):
            values = [[(v["x"], v["n"]) for v in x or []] for x in values]
            scores, spans = [mean_of(v) for v in values], [quantiles(v) for v in values]
            return ids, [None if x is None else fitted.level(x) for x in scores], langs, *([s[k] for s in spans] for k in range(3))

        return run

    rows = docs.drop("sentences").join(values, "row", "left").select("doc_id", "language", "values")
    return map_rows(rows, make, LEVELS)


def demanding_documents(documents: DataFrame, labels: DataFrame, least: float = DEMANDING) -> DataFrame:
    """``doc_id`` of the English documents whose level is above ``least``."""
    return reading_levels(documents, labels).where(F.col("level") > least).select("doc_id")
