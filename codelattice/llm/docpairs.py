"""Functions paired with the documentation that describes them.

Island grammars: per language only documentation, annotations, signatures and balanced bodies
are parsed; everything else is water that is skipped. A documentation island is parsed
further: its tags, directives, licence text, rulers, code and pointers are water, too, and a
function is documented if a sentence is left that says more than its name.

Files are parsed where they are read; parsed functions meet the nodes on (file, name), the
line deciding between namesakes. Deciding which functions are documented moves no text: one flag
per island and one per node version, combined map-side.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions.mask import mask_of, may_hold
from codelattice.llm.batches import map_rows
from codelattice.llm.comments import strip_marks
from codelattice.llm.markup import convert
from codelattice.model import norm_id
from codelattice.operators.skew import heavy_shards, sharded_join
from codelattice.session import cut

# ---- documentation islands -------------------------------------------------------------

_TAG = re.compile(r"^[ \t]*(?:[@\\][A-Za-z][\w-]*|:\w[^:\n]*:)(?:[ \t][^\n]*)?$", re.M)
_SECTION = re.compile(r"^[ \t]*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|attributes|note|notes|example|examples|see also)[ \t]*:[ \t]*$", re.I)
_FIELD = re.compile(r"^[ \t]+[\w*.]+(?:[ \t]*\([^)]*\))?[ \t]*:")
_CODE_BLOCK = re.compile(r"^```$.*?^```$", re.M | re.S)
_INLINE_TAG = re.compile(r"\{@\w+(?:[^{}]*)\}")
_HEAD = re.compile(r"^#+ .*$", re.M)
_REMINDER = re.compile(r"^\W*(?:TODO|FIXME|XXX|HACK|TBD|WIP|BUG|OPTIMIZE|REVIEW)\b(?![a-z ]*\b(?:is|are|was)\b)", re.I)
_DIRECTIVE = re.compile(
    r"""^\W*(?:eslint[-/\w]*|tslint|jshint|jslint|jscpd|nolint|noqa|NOSONAR|NOLINT\w*|noinspection|pylint|pyright|mypy|flake8|ruff|isort|yapf|fmt|black|
    type:\s*ignore|clang-(?:format|tidy)|istanbul|c8|v8|prettier-ignore|ts-(?:ignore|nocheck|expect-error|check)|@ts-\w+|cppcheck|cspell|spell-checker|
    codecov|pragma|rustfmt|clippy|go:\w+|\+build|lint:|checkstyle|CHECKSTYLE|SuppressWarnings|spotless|coverage|biome-ignore|deno-lint\w*|webpackChunkName|
    sourceMappingURL|\#?region|\#?endregion|vim:|emacs:|-\*-)(?![a-z])""",
    re.X,
)
_LICENCE = re.compile(r"\(c\)|©|copyright|all rights reserved|licen[cs]ed? under|spdx-license|governed by the terms|without warranty|redistribution and use|under the terms of|permission is hereby granted", re.I)
_POINTER = re.compile(
    r"""^\W*(?:see|cf\.?|refer\ to|compare|siehe|vgl\.?|voir|ver|v[eé]ase)\b(?:\W+(?:also|auch|aussi|tambi[eé]n))?(?:\W+(?:the|die|das|der|le|la|el))?
    (?:\W+[\w.:#/()-]+){0,5}\W*$
    | ^\W*(?:same|identical|equivalent|as|like|wie|comme|como)\b(?:\W+(?:as|to|with|in|for))?(?:\W+(?:the|its|all))?(?:\W+(?:one|other|others|above|below|before|previous|base|parent|super|overload(?:ed)?|original|interface|oben|ci-dessus|arriba|function|method|version|described|documented|see))+\W*$
    | ^\W*(?:inherit(?:s|ed)?(?:\W?doc)?|documented\ elsewhere|siehe\ oben|s\.\s?o\.|ditto|dito|idem)\b(?:\W+\w+){0,4}\W*$""",
    re.I | re.X,
)
_CODE = re.compile(
    r"""^\s*(?:
      (?:if|for|while|switch|elif|catch|foreach|match)\b\s*\(?.*[{;:)]\s*$ | (?:if|for|while|match)\b[^.]*\{.*\}?\s*$ | else\b.*[{:]?\s*$ | [})\]]+[;,)]?\s*$
      | (?:let|const|var|auto|val|int|long|double|float|bool|boolean|char|string|String|final|static|public|private|protected|export|pub|fn|def|func|function|class|struct|import|use|using|package|from|return|throw|raise|assert|yield|await|new|delete|del)\b.*(?:[;{(=:\[].*|;)$
      | [\w$.*&\[\]>-]+(?:\[[^\]]*\])*\s*(?::=|[+\-*/|&^]?=(?!=)|<<=|>>=)\s*\S.*$
      | [\w$]+(?:(?:\.|->|::)[\w$]+)+\(.*\)\s*[;{]?\s*$ | [\w$]+\([^)]*\)\s*[;{]\s*$
      | .*[;{}]\s*$
    )""",
    re.X,
)
_SPLIT = re.compile(r"(?<=[.!?;])\s+|\n")
_WORD = re.compile(r"[^\W\d_]+|\d+", re.U)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
# Words that add nothing to a name, in several languages, and phrases of stubs.
_FILLER = frozenset(
    """a an the this that these those given it its of for to in on at by with from as is are be was and or der die das ein eine den dem des le la les un une el los las una de du
    function functions method methods procedure routine helper helpers utility util fn func class struct constructor destructor getter setter accessor stub
    implementation impl does do did perform performs performed used use uses simple simply just generated auto automatic automatically template editor
    created description documentation document documents doc docs summary internal private protected public override overrides overridden overriding misc miscellaneous obvious
    self explanatory none null na n tbd placeholder missing here goes insert provided no not comment comments todo add write fill later describe describes
    see above below other one same default new main test tests unknown undocumented empty var val value values param params parameter parameters
    arg args argument arguments return returns returning result funktion methode hilfsfunktion siehe oben beschreibung keine kommentar fonction voir dessus
    funcion función metodo método ver arriba sin descripcion descripción pas""".split()
)
_STUB = re.compile(
    r"""^\W*(?:auto(?:matic(?:ally)?)?[-\s]?(?:generated)?\s(?:method|constructor|catch|function|class|type)?\s?(?:stub|block)|default\sconstructor(?:\sstub)?|created\sby\s(?:the\s)?[\w\s]{0,30}(?:template|wizard|generator|editor|ide|tool)
    |generated\s(?:getter|setter|accessor|constructor|by|stub)\b.*|(?:getter|setter)\s(?:and\s(?:getter|setter)\s)?(?:for|of)\b.*|insert\s(?:a\s)?(?:description|documentation|comment|text)\s?(?:here)?|(?:documentation|description|comment|text)\s(?:goes\s)?here
    |no\s(?:description|documentation|comment)(?:\s(?:provided|available|given|yet))?|(?:missing|lacks)\s(?:docs?|documentation|description)|lorem\sipsum.*|not\s(?:yet\s)?(?:documented|implemented)|n/?a)\W*$""",
    re.I | re.X,
)


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ing", "ied", "ies", "ed", "es", "s", "e", "y"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def name_stems(name: str) -> set[str]:
    return {_stem(w) for part in _WORD.findall(_CAMEL.sub(" ", name.replace("_", " "))) for w in [part]}


def describing_sentences(doc: str | None, name: str | None) -> list[str]:
    """The sentences of ``doc`` that tell something beyond ``name``; none for null and blank docs.

    Tags, inherited-doc marks, reminders, placeholders, rulers, directives, licence text, stub
    notes, pointers, code and headings are not sentences, and neither is what only repeats the
    words of the name with filler.
    """
    if not doc or not doc.strip():
        return []
    text = convert(_INLINE_TAG.sub(" ", strip_marks(doc)))[0] if any(c in doc for c in "<`\\{=[") else strip_marks(doc)
    text = _HEAD.sub("", _CODE_BLOCK.sub("", text)) if "#" in text or "```" in text else text
    known = name_stems(name or "")
    out, section = [], False
    for block in re.split(r"\n[ \t]*\n", text):
        if _LICENCE.search(block):
            continue
        for line in block.split("\n"):
            if _SECTION.match(line):
                section = True
                continue
            if section and (not line.strip() or line[:1] in " \t"):
                continue
            section = False
            if _TAG.match(line) or _DIRECTIVE.match(line) or _REMINDER.match(line) or _CODE.match(line):
                continue
            for s in _SPLIT.split(line):
                if _tells(s, known):
                    out.append(s.strip())
    return out


def _tells(s: str, known: set[str]) -> bool:
    words = _WORD.findall(_CAMEL.sub(" ", s.replace("_", " ")))
    if not any(len(w) > 1 and not w.isdigit() for w in words) or _STUB.match(s) or _POINTER.match(s) or _REMINDER.match(s):
        return False
    rest = [w for w in words if w.lower() not in _FILLER and not w.isdigit() and _stem(w) not in known]
    return any(len(w) > 1 for w in rest)


def judged_versions(nodes: DataFrame) -> DataFrame:
    """``id, at, ord, name, file, start_line, end_line, description`` of each row of nodes.

    ``description`` is null unless the row is a function with a telling doc. Docs are judged row
    by row before versions are compared, so no text of rejected docs moves.
    """

    def make():
        def run(ids, ats, ords, kinds, names, files, starts, ends, docs):
            # A node without a name is called what its id ends with.
            called = [n or re.split(r"::|\.|/", i)[-1] for i, n in zip(ids, names)]
            said = [" ".join(describing_sentences(d, n)) or None if k == "function" and d else None for k, n, d in zip(kinds, called, docs)]
            return ids, ats, ords, names, files, starts, ends, said

        return run

    cols = ["id", "scanned_at", "ord", "type", "name", "file", "start_line", "end_line", "doc"]
    rows = nodes.where("id is not null").withColumns({"id": norm_id("id"), "file": norm_id("file")}).select(*cols)
    rows = rows.withColumn("scanned_at", F.unix_micros(F.col("scanned_at").cast("timestamp")))
    rows = rows.withColumn("doc", F.when(F.col("type") == "function", F.col("doc")))
    return map_rows(rows, make, "id string, at bigint, ord bigint, name string, file string, start_line int, end_line int, description string")


# ---- code islands ----------------------------------------------------------------------


@dataclass(frozen=True)
class Grammar:
    """What to look for in a language: where a signature may start, how it goes on after its name, and how its body is bounded."""

    signature: re.Pattern  # up to the name, what follows is scanned
    comment: re.Pattern  # one line of documentation or annotation above a signature
    scan: Callable | None = None
    indented: bool = False  # body by indentation, documentation inside it


class Brackets:
    """A text whose round, square and curly brackets are matched, strings and comments left out; a stray one ends with the block around it."""

    def __init__(self, text: str, quotes: bool):
        self.text, self.ends, self.skips = text, {}, {}
        stack: list[int] = []
        open_ = [{"(": 0, "[": 0, "{": 0}]  # brackets of each kind that are open in each block
        for m in (_SCRIPT_TOKEN if quotes else _TOKEN).finditer(text):
            c = m[0]
            if len(c) > 1:
                self.skips[m.start()] = m.end()
            elif c in "([{":
                stack.append(m.start())
                open_[-1][c] += 1
                if c == "{":
                    open_.append({"(": 0, "[": 0, "{": 0})
            elif c == "}" and len(open_) > 1 or c != "}" and open_[-1][_OPEN[c]]:
                if c == "}":
                    open_.pop()
                while text[k := stack.pop()] != _OPEN[c]:
                    if c != "}":
                        open_[-1][text[k]] -= 1
                open_[-1][_OPEN[c]] -= 1
                self.ends[k] = m.end()
        self.order = list(self.skips)

    def blank(self, at: int) -> int:
        """The next place that is neither white space nor comment."""
        while at < len(self.text):
            if self.text[at].isspace():
                at += 1
            elif self.text[at] == "/" and at in self.skips:
                at = self.skips[at]
            else:
                break
        return at

    def at(self, at: int, what: str) -> bool:
        return self.text.startswith(what, at)

    def generics(self, at: int) -> int:
        """The end of the type parameters that begin at ``at``, or ``at`` if there are none; -1 if they stay open."""
        if not self.at(at, "<"):
            return at
        depth = 0
        for place, c in self.tokens(at):
            depth += (c == "<") - (c == ">")
            if depth == 0:
                return place + 1
            if c in (";", ")", "]", "}"):
                return -1
        return -1

    def tokens(self, at: int):
        """Places and marks from ``at`` on; what stands in brackets is passed over as one mark, the opening one."""
        while m := _MARK.search(self.text, at):
            place, c = m.start(), m[0]
            if place in self.skips:
                at = self.skips[place]
                continue
            at = self.ends.get(place, m.end())
            yield place, c

    def parameters(self, at: int) -> int:
        """The end of optional type parameters and the parameters from ``at``; -1 if there are none."""
        at = self.generics(self.blank(at))
        at = self.blank(at) if at >= 0 else at
        return self.ends.get(at, -1) if at >= 0 and self.at(at, "(") else -1

    def before(self, place: int) -> str:
        """The last character before ``place`` that is no white space."""
        while place > 0 and self.text[place - 1].isspace():
            place -= 1
        return self.text[place - 1 : place]

    def line_end(self, at: int) -> int:
        k = self.text.find("\n", at)
        return len(self.text) if k < 0 else k


# Each scan takes the match of the signature and gives (place of the body's brace, None), (None, end of a function without braces), or None.
def _scan_ts(b: Brackets, m: re.Match):
    at = m.end()
    if m["arrow"]:
        return _scan_arrow(b, at)
    at = b.parameters(at)
    if at < 0:
        return None
    at = b.blank(at)
    if b.at(at, "{"):
        return at, None
    if b.at(at, ":"):
        for place, c in b.tokens(at + 1):
            if c == "{" and b.before(place) not in ":|&<,>":
                return place, None
            if c == "{" and b.before(place) == ">" and not b.text[:place].rstrip().endswith("=>"):
                return place, None
            if c in (";", ")", "]", "}", "="):
                at = place
                break
    return (None, at) if m["name"] else None  # an overload or declared function has no body


def _scan_arrow(b: Brackets, at: int):
    if b.at(b.blank(at), ":"):
        for place, c in b.tokens(at):
            if c == "=":
                at = place
                break
            if c in (";", ")", "]", "}"):
                return None
    at = b.blank(at)
    if not b.at(at, "=") or b.text[at : at + 2] in ("==", "=>"):
        return None
    at = b.blank(at + 1)
    if m := re.compile(r"async\b(?!\s*=>)\s*").match(b.text, at):
        at = m.end()
    if m := re.compile(r"[A-Za-z_$][\w$]*\s*(?==>)").match(b.text, at):
        at = m.end()
    else:
        at = b.parameters(at)
        if at < 0:
            return None
        at = b.blank(at)
        if b.at(at, ":"):
            for place, c in b.tokens(at):
                if c == "=>":
                    at = place
                    break
                if c in (";", ")", "]", "}", "="):
                    return None
    if not b.at(at, "=>"):
        return None
    at = b.blank(at + 2)
    if b.at(at, "{"):
        return at, None
    # an expression: up to a semicolon, a closing bracket or a line end after which it does not go on
    for place, c in b.tokens(at):
        if c in (";", ")", "]", "}"):
            return None, place
        if c == "\n" and place > at and b.before(place) not in "=>+-*/&|?:,.<([{" and not re.compile(r"\s*[.?:+\-*/&|=<>,)\]]").match(b.text, place):
            return None, place
    return None, len(b.text)


def _scan_go(b: Brackets, m: re.Match):
    at = b.blank(m.end())
    at = b.ends.get(at, -1) if b.at(at, "[") else at
    at = b.parameters(at) if at >= 0 else -1
    if at < 0:
        return None
    for place, c in b.tokens(at):
        if c == "{" and not re.search(r"\b(?:interface|struct)\s*\Z", b.text[max(0, place - 40) : place]):
            return place, None
        if c == "\n":
            return None, place
    return None, len(b.text)


def _scan_rs(b: Brackets, m: re.Match):
    at = b.parameters(m.end())
    if at < 0:
        return None
    for place, c in b.tokens(at):
        if c == "{":
            return place, None
        if c in (";", "}"):
            return None, place + (c == ";")
    return None


def _head(text: str, at: int) -> str:
    """What stands before ``at`` in its line, and in those above while brackets reach there, without arguments in brackets."""
    start = text.rfind("\n", 0, at) + 1
    head = text[start:at].replace("->", "")
    while start > 0 and (head.count("<") < head.count(">") or head.count("(") < head.count(")")):
        start = text.rfind("\n", 0, start - 1) + 1
        head = text[start:at].replace("->", "")
        if ";" in head or "{" in head and "@" not in head:
            break
    old = None
    while old != head:
        old, head = head, re.sub(r"<[^<>]*>|\([^()]*\)|\[\[[^\[\]]*\]\]", " ", head)
    return head


_NOT_TYPES = frozenset("return new else throw if for while switch catch case do using goto delete assert yield co_return co_await co_yield typedef".split())
_JAVA_HEAD = re.compile(r"\s*(?:@[\w.]+\s+|(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:[\w$.?]+(?:\s*\.\s*[\w$.]+)*(?:\s*\[\s*\]|\s*\.\.\.)*\s+)?")
_CPP_HEAD = re.compile(r"\s*(?:[\w:*&~,]+[\s*&]+)*(?:\w+\s*::\s*)*~?")


def _scan_java(b: Brackets, m: re.Match):
    head = _head(b.text, m.start("name"))
    if not _JAVA_HEAD.fullmatch(head) or _NOT_TYPES & set(head.split()) or not head.strip() and not _declared(b.text, m["name"]):
        return None
    at = b.parameters(m.end())
    at = b.blank(at) if at >= 0 else at
    for place, c in b.tokens(at) if at >= 0 else ():
        between = b.text[at:place].strip()
        if c == "{":
            return (place, None) if not between or re.match(r"throws\b|\[|@", between) else None
        if c in (";", "}", ")", "=", "=>", "->"):
            return None
    return None


def _declared(text: str, name: str) -> bool:
    return re.search(rf"\b(?:class|struct|enum|record)\b[^;{{}}()]*?\b{re.escape(name)}\b", text) is not None


def _scan_cpp(b: Brackets, m: re.Match):
    name = m["name"]
    head = re.sub(r"^\s*(?:public|private|protected)\s*:(?!:)", "", _head(b.text, m.start("name")))
    if re.search(r"(?<!:):(?!:)", head) or not _CPP_HEAD.fullmatch(head) or _NOT_TYPES & set(head.split()):
        return None
    if not re.sub(r"[\s~]", "", head) and not _declared(b.text, name):
        return None  # a call or a macro
    at = b.parameters(m.end())
    listed = False
    for place, c in b.tokens(at) if at >= 0 else ():
        if c == ":" and not listed:
            listed = b.text[place - 1] != ":" and b.text[place + 1 : place + 2] != ":"
        if c == "{":
            last = b.before(place)
            if listed and (last.isalnum() or last in "_>"):
                continue  # a member's initial value
            return (place, None) if listed or re.fullmatch(r"(?s)\s*(?:const|volatile|noexcept|override|final|try|requires|mutable|throw|->|&|\[\[|//|/\*|$).*", b.text[at:place]) else None
        if c in (";", "}", ")") or c == "=" and not listed:
            return None
    return None


_C_COMMENT = re.compile(r"^[ \t]*(?://|/\*|\*|@\w|#\[)")
_OPEN = {")": "(", "]": "[", "}": "{"}
_STRINGS = r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`"
_TOKEN = re.compile(_STRINGS + r"|'(?:\\.|[^'\\\n])'|[()\[\]{}]", re.S)
_SCRIPT_TOKEN = re.compile(_STRINGS + r"|'(?:\\.|[^'\\\n])*'|[()\[\]{}]", re.S)
_MARK = re.compile(r"//|/\*|[\"`']|->|=>|[()\[\]{}<>;:=\n]")
_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_CALLED = re.compile(rf"(?<![\w$.]){_NAME}(?=[ \t]*\()(?<!\bif)(?<!\bfor)(?<!\bwhile)(?<!\bswitch)(?<!\bcatch)(?<!\breturn)(?<!\bsynchronized)(?<!\bsizeof)(?<!\bnew)(?<!\bthrow)")
GRAMMARS = {
    "py": Grammar(re.compile(rf"^(?P<in>[ \t]*)(?:async[ \t]+)?def[ \t]+{_NAME}[ \t]*[(\[]", re.M), re.compile(r"^[ \t]*[#@]"), indented=True),
    "ts": Grammar(
        re.compile(
            rf"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*{_NAME}(?=[ \t]*[<(])"
            r"|^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)[ \t]+)*(?!(?:if|for|while|switch|catch|return|function|new|else)\b)(?P<method>[A-Za-z_$][\w$]*)(?=[ \t]*[<(])"
            r"|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<arrow>[A-Za-z_$][\w$]*)(?=[ \t]*[:=])",
            re.M,
        ),
        _C_COMMENT,
        _scan_ts,
    ),
    "go": Grammar(re.compile(rf"^func[ \t]+(?:\([^)\n]*\)[ \t]*)?{_NAME}(?=[ \t]*[\[(])", re.M), _C_COMMENT, _scan_go),
    "rs": Grammar(re.compile(rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:async|const|unsafe|default|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*fn[ \t]+{_NAME}(?=[ \t]*[<(])", re.M), _C_COMMENT, _scan_rs),
    "java": Grammar(_CALLED, _C_COMMENT, _scan_java),
    "cpp": Grammar(_CALLED, _C_COMMENT, _scan_cpp),
}
GRAMMARS |= {"tsx": GRAMMARS["ts"], "js": GRAMMARS["ts"], "jsx": GRAMMARS["ts"], "cc": GRAMMARS["cpp"], "h": GRAMMARS["cpp"], "hpp": GRAMMARS["cpp"]}
_SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'|[{}]", re.S)


def _balanced_end(text: str, at: int) -> int:
    """The end of the first balanced pair of braces from ``at``; the end of text if it stays open."""
    depth = 0
    for m in _SKIP.finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
    return len(text)


def _within(b: Brackets, at: int) -> bool:
    """Whether a string or comment reaches over ``at``."""
    k = bisect_right(b.order, at) - 1
    return k >= 0 and at < b.skips[b.order[k]]


def parse_functions(text: str | None, ext: str) -> list[tuple[str, int, int, str, str, str]]:
    """``name, start_line, end_line, doc, signature, code`` of each function island of a file.

    ``start_line`` is the line of the signature, from 1. Unknown languages and null or empty
    texts have no islands; an unclosed body ends with the text.
    """
    g = GRAMMARS.get(ext.lower())
    if not text or g is None:
        return []
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    lines, out = text.split("\n"), []
    brackets = None if g.indented else Brackets(text, g.scan is _scan_ts)
    for m in g.signature.finditer(text):
        if brackets and _within(brackets, m.end() - 1):
            continue
        body = g.scan(brackets, m) if brackets else None
        if brackets and body is None:
            continue
        name = next(v for k, v in m.groupdict().items() if k != "in" and v)
        row = bisect_right(starts, m.start() + len(m[0]) - len(m[0].lstrip())) - 1  # for Java and C++ the line of the name
        top = row
        while top > 0 and g.comment.match(lines[top - 1]):
            top -= 1
        doc = "\n".join(x for x in lines[top:row] if not re.match(r"\s*(?:@\w|#\[)", x))
        if g.indented:
            inner, end = len(m["in"].expandtabs()), row + 1
            while end < len(lines) and (not lines[end].strip() or len(lines[end].expandtabs()) - len(lines[end].expandtabs().lstrip()) > inner):
                end += 1
            while end > row + 1 and not lines[end - 1].strip():
                end -= 1
            body = "\n".join(lines[row + 1 : end])
            inside = re.match(r"\s*[rRbBuU]?(\"{3}|'{3})(.*?)\1", body, re.S)
            doc, last = (inside[2] if inside else doc), end
            code = "\n".join(lines[row:end])
        else:
            stop = _balanced_end(text, body[0]) if body[1] is None else body[1]
            last = bisect_right(starts, max(stop - 1, 0))
            code = text[starts[row] : stop]
        out.append((name, row + 1, last, doc.strip(), lines[row].strip(), code))
    return out


_ISLAND = ["file", "rank", "name", "start_line"]


def _versions(files: DataFrame) -> DataFrame:
    """``path, rank, content`` of every version; the newest has the greatest rank."""
    rank = F.struct(F.coalesce("mtime_ms", F.lit(-1.0)).alias("mtime_ms"), F.coalesce(F.length("content"), F.lit(-1)).alias("n"))
    return files.where("path is not null").select(norm_id("path").alias("path"), rank.alias("rank"), "content")


def file_islands(files: DataFrame) -> DataFrame:
    """``file, rank, name, start_line, doc, signature, code`` of the function islands of every version of each file.

    A version has one more row, without a name, which tells that it is there even if it has no islands.
    """

    def make():
        def run(paths, whens, texts):
            out = [(p, w, *f) for p, w, t in zip(paths, whens, texts) for f in [(None,) * 5, *((n, a, d, g, c) for n, a, _, d, g, c in parse_functions(t, p.rpartition(".")[2]))]]
            return [list(c) for c in zip(*out)] if out else [[] for _ in range(7)]

        return run

    return map_rows(_versions(files), make, "file string, rank struct<mtime_ms:double,n:int>, name string, start_line int, doc string, signature string, code string")


def judged_islands(files: DataFrame) -> DataFrame:
    """``file, rank, name, start_line, tells`` of the function islands of every version: whether their documentation tells something. Versions have a row without name, too."""

    def make():
        def run(paths, whens, texts):
            out = [(p, w, *f) for p, w, t in zip(paths, whens, texts) for f in [(None, None, False), *((n, a, bool(describing_sentences(d, n))) for n, a, _, d, _, _ in parse_functions(t, p.rpartition(".")[2]))]]
            return [list(c) for c in zip(*out)] if out else [[] for _ in range(5)]

        return run

    return map_rows(_versions(files), make, "file string, rank struct<mtime_ms:double,n:int>, name string, start_line int, tells boolean")


def documented_functions(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``id`` of each id whose current row, of greatest (scanned_at, ord), removed or not, is a documented function.

    The signature on the node's line in the newest version of its file is the function's island; the
    documentation before or in it has to tell something. The row's own doc is what the id is
    reported for, so it has to tell something, too, and decides alone where no file has the island.
    """
    judged = judged_versions(nodes)
    cur = judged.groupBy("id").agg(F.max(F.struct("at", "ord", "name", "file", "start_line", F.col("description").isNotNull().alias("tells"))).alias("_r"))
    cur = cur.where("_r.tells").select("id", "_r.name", "_r.file", "_r.start_line")
    islands = cut(judged_islands(files))
    newest = islands.groupBy("file").agg(F.max("rank").alias("rank"))
    silent = islands.where("name is not null").join(newest, ["file", "rank"], "left_semi").groupBy("file", "name", "start_line").agg(F.max("tells").alias("tells")).where("not tells")
    return cur.join(silent, ["file", "name", "start_line"], "left_anti").select("id")


def function_pairs(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``id, name, description, signature, code``: the documented functions with their code.

    Code and node agree on file and name; of namesakes in a file the island on the node's line is
    taken, else the nearest one (the first one if the node has no line). Functions whose file or
    code is not there have no pair. Repeated rows of a file count once.

    Files are parsed in one pass; the islands are written as they come, and which one belongs to a
    function is settled by lines alone: an equality join on (file, name, line), and for what is left
    one row per file and name with its lines, so namesakes are never paired with each other. Code
    is moved once, and only that of islands which were chosen.
    """
    judged = judged_versions(nodes)
    cur = judged.groupBy("id").agg(F.max(F.struct("at", "ord", "name", "file", "start_line", "description")).alias("_r")).select("id", "_r.*")
    cur = cut(cur.where("description is not null and file is not null and name is not null").drop("at", "ord"))
    islands = cut(file_islands(files))
    light = islands.select(*_ISLAND)
    newest = light.groupBy("file").agg(F.max("rank").alias("rank"))
    lines = light.where("name is not null").join(newest, ["file", "rank"], "left_semi").distinct()
    lines = cut(lines.select("file", "rank", "name", F.col("start_line").alias("at_line")))
    exact = cur.join(lines.withColumn("start_line", F.col("at_line")), ["file", "name", "start_line"])
    rest = cut(cur.join(exact.select("id"), "id", "left_anti"))
    all_ = lines.groupBy("file", "rank", "name").agg(F.collect_list("at_line").alias("lines"))  # of one file's text
    heavy = heavy_shards(cut(rest.groupBy("file", "name").agg(F.count("*").alias("n"))), ["file", "name"])
    moved = sharded_join(rest, all_, ["file", "name"], heavy, F.col("id"))
    near = F.array_min(F.transform("lines", lambda x: F.struct(F.abs(F.coalesce("start_line", F.lit(0)) - x).alias("d"), x.alias("at_line"))))
    chosen = exact.unionByName(moved.withColumn("at_line", near["at_line"]).drop("lines"))
    chosen = cut(chosen.select("id", "description", "file", "rank", "name", F.col("at_line").alias("start_line")))
    key = F.xxhash64("file", "rank.mtime_ms", "rank.n", "name", "start_line")
    some = may_hold(islands.where("name is not null").select(*_ISLAND, "signature", "code"), mask_of(chosen.select(key.alias("h"))), key)
    return chosen.join(some.dropDuplicates(_ISLAND), _ISLAND).select("id", "name", "description", "signature", "code")
