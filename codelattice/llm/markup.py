"""HTML, Markdown, wiki and LaTeX markup in documentation, in any mixture, to plain text.

One record is one short comment, not a page made from a template, so there are no pages of
one host whose tokens could be aligned: the occurrence vectors of markup tokens do not tell
what a token marks. A grammar of blocks and spans is used instead (see README): code blocks
are cut out first, then formulas, then headings, lists and everything else, so that nothing
inside a code block or formula counts as markup.

Every record is handled by itself in one pass over the whole table; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.batches import map_rows
from codelattice.llm.comments import strip_marks

HEADING, LIST, CODE, FORMULA, OTHER = "heading", "list", "code", "formula", "other"

# Names of HTML elements by what they mark, LaTeX environments and commands.
_HTML_OTHER = (
    "a abbr acronym address article aside b bdi bdo big blockquote br button caption center cite code col colgroup data del details dfn "
    "div em figcaption figure font footer header hr i img input ins kbd label legend main mark meter nav nowiki output p picture q ref s "
    "samp section small span strike strong style sub summary sup table tbody td tfoot th thead time tr tt u var wbr"
).split()
_TEX_HEADING = "part chapter section subsection subsubsection paragraph subparagraph title".split()
_TEX_LIST = "itemize enumerate description".split()
_TEX_CODE = "verbatim lstlisting minted Verbatim alltt".split()
_TEX_FORMULA = "equation align displaymath math gather multline eqnarray alignat".split()
_TEX_SPAN = (
    "emph textbf textit texttt textsc textrm textsf textsl underline uline ref eqref autoref cref cite citep citet href url footnote label "
    "caption includegraphics mbox verb index gls"
).split()
_TEX_WORD = "ldots dots LaTeX TeX noindent newline linebreak par smallskip medskip bigskip centering textbackslash maketitle newpage clearpage hline".split()

_FLAGS = re.I | re.S | re.M
_CODE_BLOCKS = re.compile(
    r"^[ \t]*(?P<f>`{3,}|~{3,})[ \t]*[\w+#.-]*[ \t]*\n(?P<c1>.*?)(?:^[ \t]*(?P=f)[`~]*[ \t]*$|\Z)"
    r"|<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(?P<c2>.*?)(?:(?:</code>\s*)?</pre>|\Z)"
    r"|<(?P<t>syntaxhighlight|source|listing|xmp)\b[^>]*>(?P<c3>.*?)(?:</(?P=t)>|\Z)"
    r"|\{\{\{(?:\#!\w+)?[ \t]*\n(?P<c4>.*?)(?:\n[ \t]*\}\}\}|\Z)"
    rf"|\\begin\{{(?P<e>(?:{'|'.join(_TEX_CODE)})\*?)\}}(?:\[[^\]\n]*\])?(?:\{{[^}}\n]*\}})?(?P<c5>.*?)(?:\\end\{{(?P=e)\}}|\Z)"
    r"|^[ \t]*\.\.[ \t]+code(?:-block)?::[^\n]*\n(?P<c6>(?:[ \t]*\n|[ \t]+[^\n]*(?:\n|\Z))+)",
    _FLAGS,
)
_CODE_HTML = re.compile(r"<code\b[^>]*>(?P<c>[^<]*\n[^<]*)</code>", _FLAGS)  # over several lines: a block
_FORMULAS = re.compile(
    r"<math\b[^>]*>(?P<m1>.*?)</math>|(?<!\\)\$\$(?P<m2>[^$]+?)\$\$|(?<!\\)\\\[(?P<m3>.+?)\\\]|(?<!\\)\\\((?P<m4>.+?)\\\)"
    rf"|\\begin\{{(?P<e>(?:{'|'.join(_TEX_FORMULA)})\*?)\}}(?P<m5>.*?)(?:\\end\{{(?P=e)\}}|\Z)",
    _FLAGS,
)
# One dollar opens a formula only if what it encloses touches both dollars, no digit follows, and it holds an operator or is one letter.
_DOLLAR = re.compile(r"(?<![\\$\w])\$(?P<m>(?![\s\d]*\$)(?=[^\s$])(?:[^$\n]*[\\^_=+(<>{][^$\n]*|[A-Za-z]))(?<=[^\s\\])\$(?![\d\w$])")
_HEADINGS = re.compile(
    r"<h(?P<n>[1-6])\b[^>]*>(?P<h1>.*?)</h(?P=n)\s*>"
    r"|^[ \t]{0,3}(?P<w>={2,6})[ \t]*(?P<h3>[^=\n][^\n]*?)[ \t]*(?P=w)[ \t]*$"
    r"|^[ \t]{0,3}(?P<a>\#{1,6})[ \t]+(?P<h2>[^\s#][^\n]*?)[ \t]*\#*[ \t]*$"
    r"|^(?P<h4>(?![ \t]*[-*+>|=#][ \t])[^\n]*\w[^\n]*)\n[ \t]*(?P<s>={3,}|-{3,})[ \t]*$"
    rf"|\\(?:{'|'.join(_TEX_HEADING)})\*?(?:\[[^\]\n]*\])?\{{(?P<h5>[^{{}}\n]*)\}}",
    _FLAGS,
)
_ITEM = re.compile(r"^(?P<in>[ \t]*)(?:[-*+]|\*{2,4}|\d{1,3}[.)])[ \t]+(?P<box>\[[ xX]\][ \t]+)?(?P<i>(?=[^\n]*[^\W_])[^\n]*)", re.M)
_LIST_TAGS = re.compile(rf"</?(?:ul|ol|li|dl|dt|dd)\b[^<>]*>|\\(?:begin|end)\{{(?:{'|'.join(_TEX_LIST)})\*?\}}(?:\[[^\]\n]*\])?|\\item\b(?:\[[^\]\n]*\])?", re.I)
_LI = re.compile(r"\n?[ \t]*(?:<(?:li|dt|dd)\b[^<>]*>|\\item\b(?:\[[^\]\n]*\])?)[ \t]*", re.I)

_SPANS: list[tuple[re.Pattern, str]] = [
    (re.compile(r"<!--.*?-->", re.S), ""),
    (re.compile(r"^[ \t]*\{\|[^\n]*\n|^[ \t]*\|\}[ \t]*$|^[ \t]*\|-[^\n]*$", re.M), ""),  # wiki tables
    (re.compile(r"^[ \t]*[|!][ \t]*(?=[^\n|]*(?:\|\||!!))", re.M), ""),
    (re.compile(r"[ \t]*(?:\|\||!!)[ \t]*(?=[^\n]*$)", re.M), " | "),
    (re.compile(r"^[ \t]*\|?(?:[ \t]*:?-{2,}:?[ \t]*\|)+(?:[ \t]*:?-{2,}:?[ \t]*)?$\n?", re.M), ""),
    (re.compile(r"^[ \t]*\|[ \t]?(.*?)[ \t]?\|[ \t]*$", re.M), r"\1"),
    (re.compile(r"!\[([^\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"(?<![\w\]])\[([^\]\n]+)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"\[\[(?:[^\]\n|]*\|)?([^\]\n|]+)\]\]"), r"\1"),
    (re.compile(r"(?<![\w\]])\[https?://\S+[ \t]+([^\]\n]+)\]"), r"\1"),
    (re.compile(r"<https?://[^<>\s]+>"), lambda m: m[0][1:-1]),
    (re.compile(r"\{\{[ \t]*[A-Za-z][\w -]*(?:\|[^{}\n]*)?\}\}"), lambda m: m[0][2:-2].rpartition("|")[2].strip()),
    (re.compile(rf"(?<![\w<])</?(?:{'|'.join(_HTML_OTHER)})(?:\s[^<>]*)?/?>(?!>)|(?<=\w)</?(?:{'|'.join(_HTML_OTHER)})(?:\s+\w[^<>]*=[^<>]*)?/?>(?=[\s.,;:!?)]|$)|(?<=[\w.,;:!?)])</(?:{'|'.join(_HTML_OTHER)})\s*>", re.I), ""),
    (re.compile(r"(?<![\w`])``?(?!`)([^`\n]+?)``?(?![\w`])"), r"\1"),
    (re.compile(r"(?<![\w'])'''''?(?=\S)([^\n]+?)(?<=\S)'''''?(?![\w'])|(?<![\w'])'''(?=\S)([^\n]+?)(?<=\S)'''(?!')|(?<![\w'])''(?=[^\s'])([^\n']+?)(?<=[^\s'])''(?![\w'])"), lambda m: m[1] or m[2] or m[3]),
    (re.compile(r"(?<![\w*\\/])\*\*\*?(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*\*\*?(?![\w*])|(?<![\w_\\])__(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?![\w_])"), lambda m: m[1] or m[2]),
    (re.compile(r"(?<![\w*\\/)\]}])\*(?=[^\s*/])([^*\n]+?)(?<=[^\s*\\])\*(?![\w*/(])|(?<![\w_\\\]])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_(])"), lambda m: m[1] or m[2]),
    (re.compile(r"(?<![\w~])~~(?=[^\s~])([^~\n]+?)(?<=[^\s~])~~(?![\w~])"), r"\1"),
    (re.compile(r"^[ \t]{0,3}>[ \t]+(?=\S)", re.M), ""),
    (re.compile(r"^[ \t]*:{1,4}[ \t]+(?=\w)", re.M), ""),
    (re.compile(rf"\\(?:{'|'.join(_TEX_SPAN)})\*?(?:\[[^\]\n]*\])?(?:\{{[^{{}}\n]*\}})?\{{([^{{}}\n]*)\}}"), r"\1"),
    (re.compile(r"\\begin\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?|\\end\{[A-Za-z]+\*?\}"), ""),
    (re.compile(rf"\\(?:{'|'.join(_TEX_WORD)})\b(?!\\)(?:\{{\}})?"), lambda m: "..." if "dots" in m[0] else m[0][1:] if m[0][1] in "LT" else ""),
    (re.compile(r"(?<=[\w ])\\(?=[%&#$_])(?![&#]\w)"), ""),
    (re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,9}|\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6});"), None),
    (re.compile(r"(?::[a-z]+)?:[a-z]+:`[^`\n]+`"), lambda m: m[0].split("`")[1]),
]
_TIE = re.compile(r"(?<=\w)~(?=\w)")
_ENTITY = _SPANS[-2][0]
_QUICK = re.compile(r"[<>#*_`=|{}\[\]$\\~&']|^[ \t]*(?:[-+:]|\d+[.)])[ \t]|^[ \t]*-{3,}[ \t]*$", re.M)
_TAG_LINE = re.compile(r"^[ \t]*(?:@[A-Za-z]\w*|:(?:param|type|returns?|rtype|raises?|throws|see)\b[^:\n]*:|\\(?:param|return|returns|brief|throws|see)\b)[^\n]*$", re.M)
_HIDE = re.compile("\x00(\\d+)\x00")


def _unescape(m: re.Match) -> str:
    from html import unescape

    return unescape(m[0])


def convert(doc: str | None) -> tuple[str, list[str]]:
    """Plain text and the kinds of markup found.

    In the text headings start with ``#`` marks, list items with ``- ``, code blocks stand
    between ``` lines and formulas between ``$``. A null doc is an empty text without kinds.
    Doc tags and the comment's own marks are not markup; tags stay, marks go.
    """
    if not doc or not doc.strip():
        return "", []
    t = strip_marks(doc)
    if not _QUICK.search(t):
        return t.strip(), []
    found: set[str] = set()
    kept: list[str] = []

    def hide(text: str) -> str:
        kept.append(text)
        return f"\x00{len(kept) - 1}\x00"

    def code(m: re.Match) -> str:
        found.add(CODE)
        body = next(v for k, v in m.groupdict().items() if k.startswith("c") and v is not None)
        return hide("```\n" + body.strip("\n") + "\n```")

    def formula(m: re.Match) -> str:
        found.add(FORMULA)
        body = next(v for k, v in m.groupdict().items() if k.startswith("m") and v is not None)
        return hide("$" + re.sub(r"<[^<>]+>", "", body).strip() + "$")

    t = t.replace("\r\n", "\n").replace("\x00", "")
    if "`" in t or "~~~" in t or "<" in t or "{{{" in t or "\\begin" in t or "::" in t:
        t = _CODE_HTML.sub(code, _CODE_BLOCKS.sub(code, t))
    tags = _TAG_LINE.search(t)
    if tags:
        t = _TAG_LINE.sub(lambda m: hide(m[0]), t)
    if "$" in t or "\\" in t or "<" in t:
        t = _DOLLAR.sub(formula, _FORMULAS.sub(formula, t))

    def heading(m: re.Match) -> str:
        text = next(v for k, v in m.groupdict().items() if k.startswith("h") and v is not None)
        if m["s"] and (m["s"][0] == "-" and abs(len(m["s"]) - len(text.strip())) > 3 and len(m["s"]) < 3):
            return m[0]
        found.add(HEADING)
        level = int(m["n"] or len(m["a"] or m["w"] or "#"))
        return "\x01" * level + " " + text.strip() + "\n" * m[0].endswith("\n")

    if "#" in t or "==" in t or "---" in t or "<" in t or "\\" in t:
        t = _HEADINGS.sub(heading, t)
    if _LIST_TAGS.search(t):
        found.add(LIST)
        t = _LIST_TAGS.sub("", _LI.sub("\n\x02 ", t))
    if _ITEM.search(t):
        found.add(LIST)
        t = _ITEM.sub("\\g<in>\x02 \\g<i>", t)
    for pattern, by in _SPANS:
        t, n = pattern.subn(_unescape if by is None else by, t)
        if n:
            found.add(OTHER)
    if "~" in t and OTHER in found:
        t = _TIE.sub(" ", t)
    if _ENTITY.search(t):  # written twice over
        t = _ENTITY.sub(_unescape, t)
    t = re.sub("\x01+", lambda m: "#" * len(m[0]), t).replace("\x02", "-")
    t = _HIDE.sub(lambda m: kept[int(m[1])], t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", t, flags=re.M)).strip(), sorted(found)


def clean_docs(nodes: DataFrame, key: str = "ord") -> DataFrame:
    """``ord, text, elements`` of each row with a doc; rows with a null doc have no text and are left out."""

    def make():
        def run(keys, docs):
            done = [convert(d) for d in docs]
            return keys, [t for t, _ in done], [e for _, e in done]

        return run

    rows = nodes.select(F.col(key).alias("ord"), "doc").where("doc is not null")
    return map_rows(rows, make, "ord bigint, text string, elements array<string>")
