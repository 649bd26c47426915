"""Source files that nobody wrote by hand: generated, minified, copied in, or data.

Layout statistics of the whole file, with thresholds per language, tell minified files and
data tables (line lengths, share of white space and alphanumerics, density of numeric
literals, long encoded runs) and tool output that repeats one form line after line. Leading
comments tell files that carry a tool's or another project's mark. Copies without a mark are
found by content: word 5-gram containment in the given upstream texts, and Jaccard similarity
of the 5-gram sets with a file of another repository. Minhashes only propose the pairs.

Text never leaves the task that reads it: one pass makes per-file features and a sketch of
64 minhashes; only these move. Files with the same set of 5-grams are one class, so a
library that a third of all files copy verbatim is one row. Classes that share a band of the
sketch are compared, each with each: a band is cut into blocks of bounded size, and the pairs
of blocks are the tasks. The few proposed classes are read once more for their exact gram sets.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.batches import map_rows
from codelattice.model import norm_id
from codelattice.session import cut, ship


@dataclass(frozen=True)
class Layout:
    """Limits of hand-written layout in a language."""

    max_line: int = 1000  # a longer line with little white space is machine output
    mean_line: float = 75.0  # of non-blank lines
    min_space: float = 0.11  # share of white space
    digit_share: float = 0.08  # of the text in digits, and
    number_share: float = 0.45  # numeric literals among all tokens
    run: int = 60  # characters of an unbroken encoded run
    run_share: float = 0.3  # of the text in such runs
    repeats: float = 0.72  # share of lines whose form, digits aside, came before
    min_lines: int = 10  # of repeated forms
    min_tokens: int = 40  # of a table of literals, on however few lines


DEFAULT = Layout()
#: Scripts are the ones that get minified; the others tolerate dense lines, as generics and macros make them.
LAYOUTS = {"js": DEFAULT, "ts": DEFAULT, "tsx": DEFAULT, "py": Layout(min_space=0.06), "go": Layout(min_space=0.06), "java": Layout(min_space=0.06), "cpp": Layout(min_space=0.06), "rs": Layout(min_space=0.06)}

_TOOL_MARK = re.compile(
    r"""<auto-?generated | \bcode\ generated\ by\b | (?<![\w.])@generated\b | \bauto-?\ ?generated\ (?:file|code|by|from|source)\b
    | \bautomatically\ (?:generated|produced|created|written)\b
    | \b(?:file|code|module|source)\ (?:is|was|has\ been)\ (?:machine-?\ ?)?(?:generated|produced|created|emitted)\ (?:by|from|with)\b
    | \bgenerated\ (?:\w+\ ){0,3}(?:by|from|with|using)\ \S+.{0,40}\b(?:do\ not|don'?t|never)\ (?:edit|modify|change|touch)
    | \b(?:do\ not|don'?t)\ (?:edit|modify)\b.{0,30}\bre-?generate | \b(?:changes|edits)\ made\ by\ hand\ (?:will|would)\ be\ (?:lost|overwritten)
    | \bwurde\ (?:automatisch\ |maschinell\ )?(?:von\ \S+\ |aus\ \S+\ )?(?:erzeugt|generiert|erstellt)\b | \bautomatisch\ (?:erzeugt|generiert)\b
    | \bg[eé]n[eé]r[eé]e?\ (?:automatiquement\b|par\ \S+\b.{0,40}ne\ pas\ modifier) | \bgenerado\ (?:autom[aá]ticamente\b|por\ \S+\b.{0,40}no\ (?:editar|modificar))""",
    re.I | re.X,
)
_COPY_MARK = re.compile(
    r"""^\W*(?:upstream|origin|source)\s*:\s*[\w./-]+\s*@\s*v?\d
    | ^\W*(?:copied|taken|vendored|imported|adapted)(?:\ verbatim)?\ from\ [\w./@-]+\ v?\d+(?:\.\d+)+
    | ^\W*[\w.-]+\ v?\d+\.\d+(?:\.\d+)?\s*[-–—|,:]*\s*(?:\(c\)|©|copyright)""",
    re.I | re.X | re.M,
)
_COMMENT = re.compile(r"\s*(?://|/\*|\*|#(?!\s*(?:include|define|if|ifdef|ifndef|pragma|endif|\[))|<!--|\"\"\"|--\s)")
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfF]*\b")
_TOKEN = re.compile(r"\w+")
_DIGITS = re.compile(r"\d+")
_RUN = re.compile(r"[A-Za-z0-9+/=]{60,}|(?:\\x[0-9a-fA-F]{2}){15,}")
_NOT_WORD = bytes(b for b in range(256) if not (chr(b).isalnum() and b < 128))

N, BANDS = 64, 16
_R = np.random.default_rng(20240117)
_A, _B = (_R.integers(0, 1 << 63, N, dtype=np.uint64) * np.uint64(2) + np.uint64(k) for k in (1, 0))  # multiply, add, keep the upper half
_POWERS = np.array([pow(1000003, k, 1 << 64) for k in range(5)], dtype=np.uint64)


def leading_comments(text: str) -> str:
    """All comment lines before the first line of code, blocks and docstrings whole, however long."""
    at, until = 0, None  # until: what closes the block that is open
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if until is None:
            if opened := _BLOCK.match(line):
                until = _CLOSES[opened["open"]]
                line = line[opened.end() :]
            elif line.strip() and not _COMMENT.match(line):
                break
        if until is not None and (k := line.find(until)) >= 0:
            if line[k + len(until) :].strip(" \t\r;"):
                at = end + 1  # code follows in the line
                break
            until = None
        at = end + 1
    return text[:at].removesuffix("\n")


_BLOCK = re.compile(r"\s*(?:[rRuUbB]{0,2}(?P<open>/\*|<!--|\"{3}|'{3}))")
_CLOSES = {"/*": "*/", "<!--": "-->", '"""': '"""', "'" * 3: "'" * 3}

#: Layout statistics of a text, as Spark expressions over the column ``content``.
LAYOUT_SQL = {
    "n": "length(content)",
    "n_lines": "size(filter(split(content, '\n'), x -> x rlike '\\\\S'))",
    "line_chars": "aggregate(filter(split(content, '\n'), x -> x rlike '\\\\S'), 0, (a, x) -> a + length(x))",
    "max_line": "aggregate(filter(split(content, '\n'), x -> x rlike '\\\\S'), 0, (a, x) -> greatest(a, length(x)))",
    "space": "length(content) - length(translate(content, ' \n\t\r', ''))",
    "digits": "length(content) - length(translate(content, '0123456789', ''))",
}


def layout_statistics(files: DataFrame) -> DataFrame:
    """``files`` with the columns of LAYOUT_SQL; ``n_lines``, ``line_chars`` and ``max_line`` are of lines that are not blank, null for a null text."""
    return files.withColumns({k: F.expr(v).cast("int") for k, v in LAYOUT_SQL.items()})


def text_statistics(text: str) -> tuple[int, ...]:
    """The same of one text."""
    lengths = [len(x) for x in text.split("\n") if x.strip()]
    return len(text), len(lengths), sum(lengths), max(lengths, default=0), sum(map(text.count, " \n\t\r")), sum(map(text.count, "0123456789"))


def layout_kind(text: str, ext: str, words: list[str] | None = None, stats: tuple[int, ...] | None = None) -> str | None:
    """'minified', 'data', 'repetitive' or None, from the statistics of the whole text."""
    lim = LAYOUTS.get(ext, DEFAULT)
    n, n_lines, chars, longest, space, digits = stats or text_statistics(text)
    if not n_lines:
        return None
    space, mean = space / n, chars / n_lines
    if max(map(len, text.split())) >= lim.run:
        alnum = len(text.encode("latin-1", "replace").translate(None, _NOT_WORD)) / n
        if alnum > 0.6 and sum(map(len, _RUN.findall(text))) > lim.run_share * n:
            return "data"
    if n >= 300 and space < lim.min_space and (mean > lim.mean_line or longest > lim.max_line):
        return "minified"
    words = _TOKEN.findall(text) if words is None else words
    if len(words) < lim.min_tokens and n_lines < lim.min_lines:
        return None
    if digits > lim.digit_share * n and len(_NUMBER.findall(text)) > lim.number_share * len(words):
        return "data"
    lines = [x for x in text.split("\n") if x.strip()]
    if n_lines >= lim.min_lines and 1 - len(set(_DIGITS.sub("0", "\n".join(lines)).split("\n"))) / n_lines > lim.repeats:
        return "repetitive"
    # rows of literals: brackets, strings and numbers only, and no name outside quotes
    rows = [x for x in lines if x.lstrip()[0] in "[](){},;:\"'+-0123456789tfnTFN"]
    if n_lines >= lim.min_lines:
        if len(rows) > 0.8 * n_lines and sum(1 for x in rows if _LITERAL_ROW.fullmatch(x)) > 0.8 * n_lines:
            return "data"
    elif sum(map(len, rows)) > 0.8 * chars and sum(len(x) for x in rows if _LITERAL_ROW.fullmatch(x)) > 0.8 * chars:  # a few long rows
        return "data"
    return None


_LITERAL_ROW = re.compile(r"[\s\[\](){},;:]*(?:(?:\"[^\"\n]*\"|'[^'\n]*'|[-+]?(?:0x[0-9a-fA-F]+|\d[\w.]*)|true|false|null|None|True|False)[\s\[\](){},;:]*)+")


def gram_hashes(words: list[str]) -> np.ndarray:
    """Distinct 64-bit hashes of the word 5-grams, the same in every process."""
    if len(words) < 5:
        return np.empty(0, dtype=np.uint64)
    seen: dict[str, int] = {}
    h = np.array([seen.get(w) or seen.setdefault(w, zlib.crc32(w.encode()) + 1) for w in words], dtype=np.uint64)
    grams = sum(h[k : len(h) - 4 + k] * _POWERS[k] for k in range(5))
    return np.unique(grams ^ (grams >> np.uint64(29)))


def sketch(grams: np.ndarray) -> list[int] | None:
    """64 minhashes, 16 bits of each; None without grams."""
    if not len(grams):
        return None
    return ((grams[:, None] * _A + _B) >> np.uint64(32)).min(axis=0).astype(np.uint16).astype(np.int16).tolist()


def class_of(grams: np.ndarray) -> int:
    """A 64-bit hash of the set of grams."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


UPSTREAM_GRAMS = 8_000_000  # of upstream texts in one block


def upstream_grams(upstream: DataFrame) -> tuple[DataFrame, int]:
    """The distinct grams of the upstream texts as ``gram, block``, and the number of blocks, each of about UPSTREAM_GRAMS."""

    def make():
        return lambda texts: ([g for t in texts for g in gram_hashes(_TOKEN.findall(t)).view(np.int64).tolist()],)

    grams = cut(map_rows(upstream.where("content is not null").select("content"), make, "gram bigint").distinct())
    blocks = max(1, -(-grams.count() // UPSTREAM_GRAMS))
    return grams.select("gram", F.pmod("gram", F.lit(blocks)).alias("block")), blocks


def _known(given: np.ndarray, grams: np.ndarray) -> int:
    """How many of ``grams`` are in the sorted array ``given``."""
    if not len(given):
        return 0
    return int((given[np.minimum(np.searchsorted(given, grams), len(given) - 1)] == grams).sum())


def _sent(grams: DataFrame, block: int):
    """The sorted grams of a block, at most about UPSTREAM_GRAMS, as a broadcast."""
    got = grams.where(F.col("block") == block).select("gram").toArrow().column("gram").to_numpy()
    return grams.sparkSession.sparkContext.broadcast(np.sort(got.view(np.uint64)))


def repository(path: str) -> str:
    """The repository of a path: the folder below the root folder of an absolute path, the first folder of a relative one."""
    parts = path.split("/")
    return parts[2] if len(parts) > 3 and not parts[0] else parts[0]


def file_features(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """``path, kind, repo, sketch, cls`` of the newest version of each path; ``kind`` null where it and the upstream texts show nothing.

    ``cls`` is a hash of the set of 5-grams, null where there is no sketch. Upstream grams are
    taken in blocks of bounded size; one block is met while the features are made, the others
    by reading the files again.
    """
    given, blocks = upstream_grams(upstream)
    sent = _sent(given, 0)

    def make():
        known = sent.value

        def run(paths, whens, contents, *stats):
            kinds, sketches, classes, sizes, seen = [], [], [], [], []
            for path, text, *told in zip(paths, contents, *stats):
                kind = sk = cls = size = hits = None
                if text and text.strip():
                    head = leading_comments(text)
                    words = _TOKEN.findall(text)
                    kind = layout_kind(text, path.rpartition(".")[2].lower(), words, tuple(told))
                    if kind is None and _TOOL_MARK.search(head):
                        kind = "generated"
                    if kind is None:
                        grams = gram_hashes(words)
                        if _COPY_MARK.search(head):
                            kind = "copied"
                        sk = sketch(grams)
                        if sk:
                            cls, size, hits = class_of(grams), len(grams), _known(known, grams)
                kinds.append(kind)
                sketches.append(sk)
                classes.append(cls)
                sizes.append(size)
                seen.append(hits)
            return paths, whens, kinds, list(map(repository, paths)), sketches, classes, sizes, seen

        return run

    rows = layout_statistics(files.where("path is not null")).select(
        norm_id("path").alias("path"), F.struct(F.col("mtime_ms"), F.length("content").alias("n")).alias("rank"), "content", *LAYOUT_SQL
    )
    schema = "path string, rank struct<mtime_ms:double,n:int>, kind string, repo string, sketch array<smallint>, cls bigint, size int, hits int"
    newest = F.max(F.struct("rank", "kind", "repo", "sketch", "cls", "size", "hits")).alias("_r")
    f = cut(map_rows(rows, make, schema).groupBy("path").agg(newest).select("path", "_r.kind", "_r.repo", "_r.sketch", "_r.cls", "_r.size", "_r.hits"))
    for k in range(1, blocks):  # blocks are disjoint, so their hits add up
        open_ = f.where("cls is not null and kind is null").groupBy("cls").agg(F.min("path").alias("path"))
        more = class_hits(files, open_, _sent(given, k)).withColumnRenamed("hits", "more")
        f = cut(f.join(more, "cls", "left").withColumn("hits", F.col("hits") + F.coalesce("more", F.lit(0))).drop("more"))
    copy = F.col("kind").isNull() & (F.col("hits") >= 0.8 * F.col("size"))
    return f.select("path", F.when(copy, "copied").otherwise(F.col("kind")).alias("kind"), "repo", "sketch", "cls")


def nonhuman_files(files: DataFrame, upstream: DataFrame, same: float = 0.8) -> DataFrame:
    """``path, kind`` of the distinct paths whose newest version is not hand-written.

    The newest version has the greatest (mtime, length); a null mtime ranks lowest. Rows
    without path are left out; null, empty and blank texts are hand-written by definition.
    """
    f = file_features(files, upstream)
    one = F.col("lo") == F.col("hi")
    classes = f.where("cls is not null").select("cls", F.xxhash64("repo").alias("repo"), "sketch")
    classes = classes.groupBy("cls").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.first("sketch").alias("sketch"))
    classes = cut(classes.select("cls", F.when(one, F.col("lo")).alias("repo"), "sketch"))
    # The same set of grams in two repositories is settled; a class of one repository needs a near one in another.
    copied = classes.where("repo is null").select("cls").unionByName(near_copies(files, f, classes, same)).distinct()
    copies = f.where("kind is null").join(copied, "cls", "left_semi")
    return f.where("kind is not null").select("path", "kind").unionByName(copies.select("path", F.lit("copied").alias("kind")))


PROPOSE = 40  # equal minhashes of a proposed pair: 3.5 standard errors below the 51 that are expected at similarity 0.8
MASK_BITS = 1 << 26  # of the filter of paths that are read again


def near_copies(files: DataFrame, f: DataFrame, classes: DataFrame, same: float) -> DataFrame:
    """``cls`` of the classes of one repository with an exact similarity of ``same`` to a class of another one.

    The nearest proposed class is tried first. Only for classes that it does not settle, all proposed ones are.
    """
    first = cut(near_classes(classes, PROPOSE))
    named = f.join(first.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.min("path").alias("path"))
    grams = cut(class_grams(files, named))
    one = classes.where("repo is not null").select("cls")
    done = cut(exactly_near(first.select("cls", "other").join(one, "cls", "left_semi"), grams, same))
    left = first.join(one, "cls", "left_semi").join(done, "cls", "left_anti").select("cls", F.lit(True).alias("open"))
    rest = classes.join(first.select("cls"), "cls", "left_semi").join(left, "cls", "left")
    return done.unionByName(exactly_near(near_classes(rest, PROPOSE, every=True), grams, same)).distinct()


def class_grams(files: DataFrame, named: DataFrame) -> DataFrame:
    """``cls, grams`` (sorted 64-bit hashes) of the classes of ``named`` (``cls, path``)."""
    read = _read_again(files, named, lambda grams: grams.tobytes(), "grams binary")
    return read.groupBy("cls").agg(F.first("grams").alias("grams"))


def class_hits(files: DataFrame, named: DataFrame, sent) -> DataFrame:
    """``cls, hits``: how many grams of the classes of ``named`` are in the block that was sent."""
    return _read_again(files, named, lambda grams: _known(sent.value, grams), "hits int").groupBy("cls").agg(F.first("hits").alias("hits"))


def _read_again(files: DataFrame, named: DataFrame, tell, column: str) -> DataFrame:
    """``cls`` and what ``tell`` says of its grams, of the classes of ``named`` (``cls, path``), from another reading of the files.

    A bit mask of fixed size keeps other paths from being tokenized; what passes it by chance is dropped by the join.
    """
    bit = F.pmod(F.xxhash64("path"), F.lit(MASK_BITS))
    bits = named.select(bit.alias("b")).select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("v"))
    got = bits.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # at most MASK_BITS / 64 rows
    mask = np.zeros(MASK_BITS // 64, dtype=np.int64)
    mask[got.column("w").to_numpy()] = got.column("v").to_numpy()
    masks = files.sparkSession.sparkContext.broadcast(mask)

    def make():
        m = masks.value

        def run(bits, texts):
            classes, out = [], []
            for b, t in zip(bits, texts):
                if m[b >> 6] >> (b & 63) & 1:
                    grams = gram_hashes(_TOKEN.findall(t))
                    classes.append(class_of(grams))
                    out.append(tell(grams))
            return classes, out

        return run

    rows = files.where("path is not null and content is not null").select(norm_id("path").alias("path"), "content").select(bit.alias("bit"), "content")
    return map_rows(rows, make, f"cls bigint, {column}").join(named.select("cls"), "cls", "left_semi")


def exactly_near(pairs: DataFrame, grams: DataFrame, same: float) -> DataFrame:
    """``cls`` of the pairs ``cls, other`` whose gram sets have a Jaccard similarity of at least ``same``."""

    def make():
        def run(classes, mine, theirs):
            out = []
            for c, a, b in zip(classes, mine, theirs):
                a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both >= same * (len(a) + len(b) - both):
                    out.append(c)
            return (out,)

        return run

    rows = pairs.join(grams.withColumnRenamed("grams", "mine"), "cls")
    rows = rows.join(grams.select(F.col("cls").alias("other"), F.col("grams").alias("theirs")), "other").select("cls", "mine", "theirs")
    return map_rows(rows, make, "cls bigint").distinct()


BLOCK = 4096  # classes on a side of one comparison task


def near_classes(classes: DataFrame, least: int, block: int = 0, every: bool = False) -> DataFrame:
    """``cls, other``: for each class its nearest one in another repository, if they share a band and ``least`` minhashes.

    ``classes`` has ``cls, repo, sketch``; a null ``repo`` stands for several. All pairs of a band
    are compared: its classes are dealt into blocks, each pair of blocks is one group. With
    ``every``, each such pair is given, for the classes whose column ``open`` is true.
    """
    block = block or BLOCK
    width = N // BANDS
    bands = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sketch", b * width + 1, width))))
    wanted = F.col("open") if every else F.lit(True)
    keyed = classes.select("cls", "repo", wanted.alias("wanted"), bands.alias("band"))  # short rows: sketches are not multiplied
    size = keyed.groupBy("band").agg(F.count("*").alias("n"), F.count("repo").alias("single"), F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.max("wanted").alias("wanted"))
    # A band in one repository only proves nothing, and neither does one without open classes.
    size = size.where("wanted and single > 0 and (lo <> hi or single < n)").select("band", F.ceil(F.col("n") / block).alias("parts"))
    some = keyed.join(size, "band").select("band", "cls", "parts", F.pmod("cls", "parts").alias("at"))
    some = some.select("band", "cls", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("mate"))
    rows = some.select("band", F.least("at", "mate").alias("x"), F.greatest("at", "mate").alias("y"), "at", "cls").join(classes, "cls")

    def compare(t: pa.Table) -> pa.Table:
        cls, at = t.column("cls").to_numpy(), t.column("at").to_numpy()
        repo, many = t.column("repo").fill_null(0).to_numpy(), t.column("repo").is_null().to_numpy()
        s = t.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, N)
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        a, b = np.flatnonzero(at == x), np.flatnonzero(at == y)
        sides = [(a, b)] if x == y else [(a, b), (b, a)]
        if every:
            asked = t.column("open").fill_null(False).to_numpy()
            sides = [(u[asked[u]], v) for u, v in sides]
        out = [_nearest(s, repo, many, u, v, least, every) for u, v in sides]
        i, j, n = (np.concatenate(c) for c in zip(*out))
        return pa.table({"cls": cls[i], "other": cls[j], "agree": n.astype(np.int32)})

    ship(classes.sparkSession)
    found = rows.groupBy("band", "x", "y").applyInArrow(compare, "cls bigint, other bigint, agree int")
    if every:
        return found.select("cls", "other").distinct()
    return found.groupBy("cls").agg(F.max(F.struct("agree", "other")).alias("_m")).select("cls", "_m.other")


def _nearest(s, repo, many, a, b, least, every=False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a``, the rows of ``b`` of other repositories that agree most with them (or all), and how much, from ``least`` on."""
    out = []
    for k in range(0, len(a), 256):
        u = a[k : k + 256]
        agree = np.zeros((len(u), len(b)), dtype=np.uint8)
        for c in range(N):
            agree += s[u, c][:, None] == s[b, c]
        agree[(repo[u][:, None] == repo[b]) & ~(many[u][:, None] | many[b]) | (u[:, None] == b)] = 0
        if every:
            i, j = np.nonzero(agree >= least)
            out.append((u[i], b[j], agree[i, j]))
        elif len(b):
            at = agree.argmax(axis=1)
            n = agree[np.arange(len(u)), at]
            out.append((u[n >= least], b[at[n >= least]], n[n >= least]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, dtype=int),) * 3
