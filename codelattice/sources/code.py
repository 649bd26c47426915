"""Nodes and edges from source text: definitions, imports, calls and type references.

A lexer blanks out comments and strings; what is left is searched for definitions, whose
bodies are bounded by braces or indentation, and for calls within them. Python is parsed by
its own parser where it can be. Files are independent: one Arrow pass, no shuffle.

Fidelity: names, scopes, lines, docs, ``defines`` and ``imports`` are exact for ordinary code; calls
follow a table of decisions (standard library, built in, shadowed, imported, local, unknown) and
are as good as names allow, since no types are inferred.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.session import ship, spread
from codelattice.sources.names import BUILT_INS, is_standard

# Words that look like calls but are none, per language family.
_CONTROL = frozenset("if for while switch catch return else do new throw match".split())
_KEYWORDS = {
    "ts": _CONTROL | frozenset("function try await typeof in of instanceof void delete yield super import export class extends constructor as case with".split()),
    "py": _CONTROL | frozenset("elif except lambda not and or is in del assert print yield with await from import def class super raise".split()) - {"catch", "switch", "do", "new", "throw", "match"},
    "go": _CONTROL | frozenset("func go defer select case range chan map struct interface type import package var const".split()) - {"while", "catch", "do", "new", "throw", "match"},
    "rs": _CONTROL | frozenset("loop unsafe move in as fn let mut ref impl where async await".split()) - {"switch", "catch", "do", "new", "throw"},
    "java": _CONTROL | frozenset("try super this synchronized assert instanceof case".split()) - {"match"},
    "cpp": _CONTROL | frozenset("try sizeof typedef using case delete alignas operator".split()) - {"match"},
}
_LANG = {"ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "cjs": "ts", "py": "py", "go": "go", "rs": "rs", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "cpp", "h": "cpp", "hpp": "cpp", "hxx": "cpp"}

_N = r"(?P<name>[A-Za-z_$][\w$]*)"
_NOT = r"(?!(?:if|for|while|switch|catch|return|function|new|else|do|throw|match)\b)"
_DEFS: dict[str, list[tuple[str, re.Pattern]]] = {
    "ts": [
        ("class", re.compile(rf"\bclass\s+{_N}")), ("interface", re.compile(rf"\binterface\s+{_N}")), ("enum", re.compile(rf"\benum\s+{_N}")),
        ("type", re.compile(rf"\btype\s+{_N}\s*(?:<[^=]*>)?\s*=")), ("function", re.compile(rf"\bfunction\s*\*?\s*{_N}\s*(?:<[^>(]*>)?\(")),
        ("function", re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)[ \t]+)*{_NOT}{_N}[ \t]*(?:<[^>(]*>)?\([^()\n]*\)[ \t]*(?::[^{{=;\n]+)?\{{", re.M)),
        ("function", re.compile(rf"\b(?:const|let|var)\s+{_N}\s*(?::[^=\n]+)?=\s*(?:async\s*)?\([^()\n]*\)[^=\n]*=>")),
    ],
    "go": [
        ("struct", re.compile(rf"^type\s+{_N}\s+struct\b", re.M)), ("interface", re.compile(rf"^type\s+{_N}\s+interface\b", re.M)), ("type", re.compile(rf"^type\s+{_N}\s+(?!struct\b|interface\b)", re.M)),
        ("function", re.compile(rf"^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?{_N}\s*(?:\[[^\]\n]*\])?\(", re.M)),
    ],
    "rs": [
        ("struct", re.compile(rf"\bstruct\s+{_N}")), ("enum", re.compile(rf"\benum\s+{_N}")), ("trait", re.compile(rf"\btrait\s+{_N}")), ("macro", re.compile(rf"\bmacro_rules!\s+{_N}")),
        ("function", re.compile(rf"\bfn\s+{_N}\s*(?:<[^>(]*>)?\(")), ("", re.compile(r"\bimpl\b(?:\s*<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)")),
    ],
    "java": [
        ("class", re.compile(rf"\b(?:class|record)\s+{_N}")), ("function", re.compile(rf"@interface\s+{_N}")), ("interface", re.compile(rf"(?<!@)\binterface\s+{_N}")), ("enum", re.compile(rf"\benum\s+{_N}")),
        ("function", re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)[ \t]+)*(?:<[^>]*>[ \t]+)?{_NOT}[\w$.<>\[\],?]+[ \t]+{_NOT}{_N}[ \t]*\([^;{{}}()]*\)[ \t]*(?:throws[^{{;]+)?[{{;]", re.M)),
    ],
    "cpp": [
        ("class", re.compile(rf"\b(?<!enum )class\s+{_N}(?=[^;()]*\{{)")), ("struct", re.compile(rf"\bstruct\s+{_N}(?=[^;()]*\{{)")), ("", re.compile(rf"\bnamespace\s+{_N}\s*\{{")),
        ("function", re.compile(rf"^[ \t]*(?:(?:static|inline|virtual|explicit|constexpr|friend)[ \t]+)*{_NOT}(?!using\b|typedef\b|public\b|private\b)[\w:<>,*&~]+(?:[ \t]+[\w:<>,*&]+)*[ \t*&]+(?:(?P<owner>\w+)::)?{_NOT}{_N}[ \t]*\([^;{{}}]*\)[ \t]*(?:const|noexcept|override|final|[ \t])*\{{", re.M)),
    ],
    "py": [("class", re.compile(rf"^[ \t]*class\s+{_N}", re.M)), ("function", re.compile(rf"^[ \t]*(?:async\s+)?def\s+{_N}\s*\(", re.M))],
}
_BLANK = {
    "py": re.compile(r"\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*", re.S),
    "rs": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S),
    "go": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'", re.S),
}
_BLANK_C = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_IMPORT = {
    "ts": re.compile(r"^[ \t]*(?:import|export)\s+(?:type\s+)?(?:(?P<what>[^'\";]*?)\s+from\s+)?['\"](?P<src>[^'\"]+)['\"]|\brequire\(\s*['\"](?P<req>[^'\"]+)['\"]\s*\)", re.M),
    "py": re.compile(r"^[ \t]*(?:from\s+(?P<src>[\w.]+)\s+import\s+(?P<what>[^\n#;]+)|import\s+(?P<req>[^\n#;]+))", re.M),
    "go": re.compile(r"^[ \t]*(?:import\s+)?(?:(?P<what>[\w.]+)\s+)?\"(?P<src>[^\"\n]+)\"[ \t]*$", re.M),
    "rs": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<src>[^;]+);", re.M),
    "java": re.compile(r"^[ \t]*import\s+(?:static\s+)?(?P<src>[\w.]+(?:\.\*)?)\s*;", re.M),
    "cpp": re.compile(r"^[ \t]*#\s*include\s+[<\"](?P<src>[^>\"\n]+)[>\"]", re.M),
}
_CALL = re.compile(r"(?<![\w$])(?P<name>[A-Za-z_$][\w$]*)(?P<bang>!)?\s*\(")
_OPERATORS = ("?.", ".", "->", "::")
_TYPE_REF = re.compile(r"(?:\bnew\s+|\bextends\s+|\bimplements\s+|:\s*&?(?:mut\s+)?|->\s*|<)(?P<name>[A-Z]\w*)")


@dataclass
class Symbol:
    id: str
    kind: str
    name: str
    start: int
    end: int
    line: int
    end_line: int
    scope: tuple[str, ...] = ()
    parent: str = ""


@dataclass
class Fragment:
    """What one file adds to the graph."""

    nodes: list[tuple] = field(default_factory=list)  # id, type, name, file, start_line, end_line, external, doc, deprecated
    edges: list[tuple] = field(default_factory=list)  # source, target, type, confidence, caller_line


def blank(text: str, lang: str) -> str:
    """The text with comments and strings overwritten by spaces; line breaks stay where they are."""
    return _BLANK.get(lang, _BLANK_C).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def symbols(text: str, path: str, lang: str) -> list[Symbol]:
    """Definitions in order, with ids ``<file>::<Outer.Inner.name>``."""
    if lang == "py":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")  # about escapes in strings
                return _python_symbols(ast.parse(text), path, text)
        except (SyntaxError, ValueError, RecursionError):
            pass
    clean = blank(text, lang)
    starts = [0] + [m.end() for m in re.finditer("\n", clean)]
    line_of = lambda at: bisect_right(starts, at)
    found: dict[int, tuple] = {}
    for kind, pattern in _DEFS[lang]:
        for m in pattern.finditer(clean):
            at = m.start("name")
            if at not in found and m["name"] not in _CONTROL:
                found[at] = (kind, m["name"], m.groupdict().get("owner"), m.start(), m.end())
    ends = _closing(clean) if lang != "py" else {}
    out, stack = [], []  # stack of (end, segment, node id)
    for at in sorted(found):
        kind, name, owner, _, after = found[at]
        if lang == "py":
            end = _indent_end(clean, starts, at)
        else:
            brace, semi = clean.find("{", max(at, after - 1)), clean.find(";", after - 1)
            stop = brace if brace >= 0 and (semi < 0 or brace < semi or kind == "type") else -1
            end = ends.get(stop, len(clean)) if stop >= 0 else (semi if semi >= 0 else len(clean))
        while stack and stack[-1][0] <= at:
            stack.pop()
        scope = tuple(s[1] for s in stack) + ((owner,) if owner else ())
        if kind:
            parent = next((s[2] for s in reversed(stack) if s[2]), path) if not owner else f"{path}::{'.'.join(scope)}"
            sid = f"{path}::{'.'.join((*scope, name))}"
            out.append(Symbol(sid, kind, name, at, end, line_of(at), line_of(max(at, end - 1)), scope, parent))
            stack.append((end, name, sid))
        else:
            stack.append((end, name, f"{path}::{'.'.join((*scope, name))}" if any(s.id == f"{path}::{'.'.join((*scope, name))}" for s in out) else ""))
    return out


def _closing(clean: str) -> dict[int, int]:
    """Position of each opening brace to the position after its closing one."""
    out, stack = {}, []
    for m in re.finditer(r"[{}]", clean):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out


def _indent_end(clean: str, starts: list[int], at: int) -> int:
    row = bisect_right(starts, at) - 1
    line = clean[starts[row] : starts[row + 1] if row + 1 < len(starts) else len(clean)]
    base, end = len(line) - len(line.lstrip()), starts[row] + len(line)
    for k in range(row + 1, len(starts)):
        x = clean[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(clean)]
        if x.strip() and len(x) - len(x.lstrip()) <= base:
            break
        end = starts[k] + len(x)
    return end


def _python_symbols(tree: ast.AST, path: str, text: str) -> list[Symbol]:
    starts = [0] + [m.end() for m in re.finditer("\n", text)] + [len(text)]
    out: list[Symbol] = []

    def walk(node: ast.AST, scope: tuple[str, ...], parent: str) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                sid = f"{path}::{'.'.join((*scope, x.name))}"
                kind = "class" if isinstance(x, ast.ClassDef) else "function"
                out.append(Symbol(sid, kind, x.name, starts[x.lineno - 1], starts[min(x.end_lineno, len(starts) - 1)], x.lineno, x.end_lineno, scope, parent))
                walk(x, (*scope, x.name), sid)
            else:
                walk(x, scope, parent)

    walk(tree, (), path)
    return out


def imports(text: str, lang: str) -> list[tuple[str, dict[str, str]]]:
    """``(source, {local name: imported name})`` of each import; '*' stands for a whole module."""
    out = []
    raw = text if lang in ("ts", "go", "cpp") else blank(text, lang)
    if lang == "go":
        blocks = re.findall(r"^import\s*\(([^)]*)\)", raw, re.M) + re.findall(r"^import[ \t]+[^\n(]+", raw, re.M)
        raw = "\n".join(blocks)
    for m in _IMPORT[lang].finditer(raw):
        g = m.groupdict()
        what = (g.get("what") or "").strip()
        if lang == "ts":
            names = {}
            for part in re.sub(r"^\w+\s*,\s*", lambda x: x[0], what).replace("{", ",").replace("}", ",").split(","):
                a = part.strip().removeprefix("type ").split(" as ")
                if a[0]:
                    names[a[-1].strip()] = a[0].strip()
            out.append((g["src"] or g["req"], names))
        elif lang == "py":
            if g["req"]:
                for part in g["req"].split(","):
                    a = part.strip().split(" as ")
                    if a[0]:
                        out.append((a[0].strip(), {a[-1].strip().split(".")[0]: "*"}))
            else:
                pairs = (p.strip(" ()").split(" as ") for p in what.split(","))
                out.append((g["src"], {a[-1].strip(): a[0].strip() for a in pairs if a[0]}))
        elif lang == "rs":
            out += [(src, {name: real}) for src, name, real in _use_tree(re.sub(r"\s+", " ", g["src"].strip()))]
        elif lang == "java":
            last = g["src"].rpartition(".")[2]
            out.append((g["src"], {last: last} if last != "*" else {}))
        elif lang == "go":
            out.append((g["src"], {what or g["src"].rpartition("/")[2]: "*"}))
        else:
            out.append((g["src"], {}))
    return out


def _use_tree(use: str, base: str = "") -> list[tuple[str, str, str]]:
    """``(path, local name, name)`` of each leaf of a Rust use tree."""
    use = use.strip()
    cut = use.find("{")
    if cut >= 0:
        inner, depth, part, out = use[cut + 1 : use.rfind("}")], 0, "", []
        for c in inner + ",":
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 0:
                if part.strip():
                    out += _use_tree(part, base + use[:cut])
                part = ""
            else:
                part += c
        return out
    path, _, alias = (base + use).partition(" as ")
    path = path.strip().removesuffix("::self")
    last = path.rpartition("::")[2]
    return [(path, alias.strip() or last, last)]


def parse(text: str | None, path: str) -> Fragment:
    """The fragment of one file; unknown languages, null and blank texts give the file's node only."""
    frag = Fragment([(path, "file", path.rpartition("/")[2], path, 0, None, False, None, None)])
    lang = _LANG.get(path.rpartition(".")[2].lower())
    if not lang or not text or not text.strip():
        return frag
    text = text.removeprefix("\ufeff").replace("\0", "")
    syms = symbols(text, path, lang)
    ids = {s.id for s in syms}
    seen_nodes, seen_edges = {path}, set()

    def node(*row) -> None:
        if row[0] not in seen_nodes:
            seen_nodes.add(row[0])
            frag.nodes.append(row + (None,) * (9 - len(row)))

    def edge(a: str, b: str, kind: str, conf: str, line: int | None = None) -> None:
        if a != b and (a, b) not in seen_edges:
            seen_edges.add((a, b))
            frag.edges.append((a, b, kind, conf, line))

    docs = symbol_docs(text, lang, syms)
    for s in syms:
        doc = docs.get(s.start)
        node(s.id, s.kind, s.name, path, s.line, s.end_line, False, doc, "@deprecated" in doc if doc and lang == "ts" else None)
        edge(s.parent if s.parent in ids else path, s.id, "defines", "EXTRACTED")
        for link in doc_links(doc) if lang == "ts" else ():
            node(link, "file", link.rpartition("/")[2], link, 0, None, True)
            edge(s.id, link, "explains", "EXTRACTED")
    bound: dict[str, tuple[str, str]] = {}
    packs: dict[str, str] = {}
    standard = set()
    for src, names in imports(text, lang):
        if is_standard(src, lang, lang == "cpp" and f"<{src}>" in text):
            standard.update(names)
            continue
        pack = f"import::{src}"
        node(pack, "file", pack[8:], "", 0, None, True)
        edge(path, pack, "imports", "EXTRACTED")
        packs[src] = pack
        for local, real in names.items():
            bound[local] = (src, real)
    clean = blank(text, lang)
    starts = [0] + [m.end() for m in re.finditer("\n", clean)]
    by_name: dict[str, list[Symbol]] = {}
    for s in syms:
        by_name.setdefault(s.name, []).append(s)
    order = sorted(syms, key=lambda s: s.start)
    at_start = {s.start for s in syms} | {s.start + len(re.match(r"[^\w]*(?:async\s+)?(?:def|class)\s+", clean[s.start :] or " ")[0]) for s in syms if lang == "py" and re.match(r"[^\w]*(?:async\s+)?(?:def|class)\s+", clean[s.start :])}
    words, skip, prefix = _KEYWORDS[lang], BUILT_INS[lang], "" if lang == "ts" else "import::"
    outer = _declared(clean, lang, 0, len(clean), syms) if lang in ("ts", "go") else frozenset()
    inner = {s.start: _parameters(clean, lang, s) | _declared(clean, lang, s.start, s.end, ()) for s in syms if s.kind == "function"}
    known = lambda x: lang == "ts" and (x in by_name or x in bound)
    open_: list[Symbol] = []
    k = 0
    openings = _openings(clean)
    for m in _CALL.finditer(clean):
        name, at = m["name"], m.start("name")
        obj = _receiver(clean, at, openings)
        if name in words or at in at_start or obj in words and obj not in ("this", "self", "super"):
            continue
        if name in skip and not known(name) or obj is not None and obj in skip - _SELVES and not known(obj):
            continue
        if (obj or name) in standard or obj is not None and lang in ("py", "rs", "java") and obj not in bound and obj not in by_name and is_standard(obj, lang):
            continue
        while k < len(order) and order[k].start <= at:
            open_.append(order[k])
            k += 1
        open_ = [s for s in open_ if s.end > at]
        caller = max(open_, key=lambda s: s.start) if open_ else None
        if caller and caller.start <= at < caller.start + len(caller.name) + 1:
            continue
        if obj is None and (name in outer or any(name in inner.get(s.start, ()) for s in open_)):
            continue  # a variable or parameter
        who, line = caller.id if caller else path, bisect_right(starts, at)
        local = [s for s in by_name.get(name, ()) if s.kind == "function" or obj is None]
        if obj is not None and obj not in ("this", "self", "super", "cls"):
            if obj in bound:
                target = f"{prefix}{bound[obj][0]}::{name}"
                _external(node, edge, who, target, name, line)
                if lang in ("ts", "py"):
                    edge(packs[bound[obj][0]], target, "defines", "EXTRACTED")
            elif obj in by_name:
                own = [s for s in local if s.scope[-1:] == (obj,)] or local
                if len(own) == 1:
                    edge(who, own[0].id, "calls", "EXTRACTED", line)
                elif own:
                    for s in own:
                        edge(who, s.id, "calls", "AMBIGUOUS", line)
                else:
                    _external(node, edge, who, f"{path}::{obj}.{name}", name, line)
            elif len(local) == 1:
                edge(who, local[0].id, "calls", "INFERRED", line)
            elif local:
                for s in local:
                    edge(who, s.id, "calls", "AMBIGUOUS", line)
            elif lang not in ("ts", "py"):
                _ghost(node, edge, who, name, path, line)
            continue
        first = [name in bound, bool(local)]
        if (first[0] and not (lang == "py" and first[1])) and obj is None:
            src, real = bound[name]
            target = f"{prefix}{src}::{real if real != '*' else name}"
            _external(node, edge, who, target, name, line)
            if lang in ("ts", "py"):
                edge(packs[src], target, "defines", "EXTRACTED")
        elif local:
            scope = caller.scope if caller else ()
            common = lambda s: next((i for i, (a, b) in enumerate(zip(s.scope, scope)) if a != b), min(len(s.scope), len(scope)))
            best = max(local, key=lambda s: (common(s), -s.start))
            edge(who, best.id, "calls", "EXTRACTED", line)
        elif obj is None:
            _ghost(node, edge, who, name, path, line)
    for m in _TYPE_REF.finditer(clean):
        at = m.start("name")
        if any(m["name"] in inner.get(s.start, ()) for s in order if s.start <= at < s.end):
            continue
        hits = [s for s in by_name.get(m["name"], ()) if s.kind != "function"]
        if hits:
            inside = [s for s in order if s.start <= at < s.end]
            edge(max(inside, key=lambda s: s.start).id if inside else path, hits[0].id, "references", "EXTRACTED", bisect_right(starts, at))
    return frag


def _openings(clean: str) -> dict[int, int]:
    """Position after each closing round or square bracket to that of its opening one."""
    out, stack = {}, []
    for m in re.finditer(r"[()\[\]]", clean):
        if m[0] in "([":
            stack.append(m.start())
        elif stack:
            out[m.end()] = stack.pop()
    return out


def _receiver(clean: str, at: int, openings: dict[int, int]) -> str | None:
    """The first name of the chain that a call at ``at`` ends, as ``a`` in ``a.b(c)?.d(``; None for a bare call or an expression."""
    root = None
    while True:
        at = len(clean[max(0, at - 200) : at].rstrip()) + max(0, at - 200)
        op = next((o for o in _OPERATORS if clean.startswith(o, at - len(o))), None) if at > 1 else None
        if op is None:
            return root
        at -= len(op)
        at = len(clean[max(0, at - 200) : at].rstrip()) + max(0, at - 200)
        if clean[at - 1 : at] == "!":
            at -= 1
        while at in openings:
            at = openings[at]
        end = at
        while at > 0 and (clean[at - 1].isalnum() or clean[at - 1] in "_$"):
            at -= 1
        if at == end:
            return None
        root = clean[at:end]


_SELVES = frozenset(("this", "self", "super", "cls", "Self"))
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_ANNOTATION = re.compile(r"(?:@[\w.]+(?:\([^)]*\))?|#!?\[[^\]]*\]|template\s*<[^>]*>)\s*\Z")


def symbol_docs(text: str, lang: str, syms: list[Symbol]) -> dict[int, str]:
    """The documentation of each symbol, by its place: what comments stand right before it, as each language writes them.

    Scripts keep the comments as they are, others without their marks; Java takes a ``/**`` block only,
    Rust lines of ``///`` and ``//!`` only, Python the docstring.
    """
    if lang == "py":
        return {s.start: d for s in syms if (d := _docstring(text, s))}
    spans = {m.end(): m.start() for m in _COMMENT.finditer(text) if blank(text[m.start() : m.end()], lang).strip() == ""}
    ends = sorted(spans)
    out = {}
    for s in syms:
        at = text.rfind("\n", 0, s.start) + 1
        got: list[str] = []
        while True:
            at = len(text[:at].rstrip())
            if at in spans:
                k = bisect_right(ends, at) - 1
                got.insert(0, text[spans[ends[k]] : at])
                at = spans[ends[k]]
            elif not got and (m := _ANNOTATION.search(text, max(0, at - 300), at)):
                at = m.start()
            else:
                break
        doc = _doc_text(got, lang)
        if doc:
            out[s.start] = doc
    return out


def _doc_text(comments: list[str], lang: str) -> str | None:
    if lang == "ts":
        return "\n".join(comments) or None
    if lang == "java":
        if not comments or not comments[-1].startswith("/**"):
            return None
        lines = (re.sub(r"^\s*\*\s?", "", x).strip() for x in comments[-1].removeprefix("/**").removesuffix("*/").split("\n"))
        return "\n".join(x for x in lines if x) or None
    if lang == "rs":
        kept: list[str] = []
        for c in reversed(comments):
            if not c.startswith(("///", "//!")):
                break
            kept.insert(0, c[3:].strip())
        return "\n".join(kept) or None
    return "\n".join(re.sub(r"^//|^/\*|\*/$", "", c).strip() for c in comments) or None


def _docstring(text: str, s: Symbol) -> str | None:
    """The string that opens the body of a Python definition."""
    head = re.compile(r"(?:[^\n:\"'#]|\([^()]*(?:\([^()]*\)[^()]*)*\)|:(?!\s*(?:#[^\n]*)?\n))*:\s*(?:#[^\n]*)?\n\s*[rRuUbB]?(\"{3}|'{3}|\"|')(.*?)\1", re.S)
    body = text[s.start : s.end]
    k = body.find("def ") if s.kind == "function" else body.find("class ")
    m = head.match(body, max(0, k))
    return m[2].strip() or None if m else None


def doc_links(doc: str | None) -> list[str]:
    """What ``@see`` and ``{@link}`` of a documentation comment point to, in order of kind."""
    found = [*re.findall(r"@see\s+([^\s}]+)", doc), *re.findall(r"\{@link\s+([^\s}]+)", doc)] if doc else []
    return [x for x in (re.sub(r"['\"]", "", f) for f in found) if x]


_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_LOCALS = {
    "ts": re.compile(r"\b(?:const|let|var)\s+(?P<names>\{[^{}]*\}|\[[^\[\]]*\]|[A-Za-z_$][\w$]*)"),
    "py": re.compile(r"^[ \t]*+(?P<names>[\w*][\w*, ()]*+)(?::[^=\n]*+)?=(?!=)|\bfor[ \t]++(?P<each>(?:(?!\bin\b)[\w, ()])++)in\b|\bas[ \t]++(?P<as>\w+)|\blambda\b(?P<args>[^:\n]*+):", re.M),
    "go": re.compile(r"(?P<names>\w+(?:\s*,\s*\w+)*)\s*:=|\b(?:var|const)\s+(?P<var>\w+)"),
    "rs": re.compile(r"\blet\s+(?:mut\s+)?(?P<names>\([^()=]*\)|\w+)|\bfor\s+(?P<each>\w+)\s+in\b|\|(?P<args>[^|\n]*)\|"),
    "java": re.compile(r"^[ \t]*+(?:final[ \t]++)?[\w<>\[\],.?]++[ \t]++(?P<names>\w++)[ \t]*+(?:=(?!=)|;)|\bfor\s*\(\s*(?:final\s+)?[\w<>\[\],.]+\s+(?P<each>\w+)\s*[:=]", re.M),
    "cpp": re.compile(r"^[ \t]*+(?:const[ \t]++)?[\w:<>,*&]++[ \t*&]++(?P<names>\w++)[ \t]*+(?:=(?!=)|;|\{)|\bfor\s*\(\s*(?:const\s+)?[\w:<>,]+[\s*&]+(?P<each>\w+)\s*[:=]", re.M),
}


def _declared(clean: str, lang: str, start: int, end: int, syms) -> frozenset[str]:
    """Names of variables declared between two places; with ``syms`` only those outside of functions."""
    out: set[str] = set()
    bodies = sorted((s.start, s.end) for s in syms if s.kind == "function" and "\n" in clean[s.start : s.end])
    for m in _LOCALS[lang].finditer(clean, start, end):
        if bodies and any(a < m.start() < b for a, b in bodies):
            continue
        for v in m.groupdict().values():
            if v:
                out.update(_WORD.findall(v))
    return frozenset(out - {"self", "cls", "in", "mut", "const", "return", "new", "else"})


def _parameters(clean: str, lang: str, s: Symbol) -> frozenset[str]:
    """Names in the parameter list of a function: all of them in scripts and Python, where types and defaults count, too."""
    open_ = clean.find("(", s.start)
    if open_ < 0 or open_ >= s.end:
        return frozenset()
    depth, k = 0, open_
    while k < s.end:
        depth += (clean[k] == "(") - (clean[k] == ")")
        if depth == 0:
            break
        k += 1
    inside = clean[open_ + 1 : k]
    if lang in ("ts", "py"):
        return frozenset(_WORD.findall(inside))
    parts = re.sub(r"<[^<>]*>", "", inside).split(",")
    if lang == "rs":
        return frozenset(w for p in parts for w in _WORD.findall(p.split(":")[0]))
    if lang == "go":
        return frozenset(w[0] for p in parts if (w := _WORD.findall(p)) and len(p.split()) > 1)
    return frozenset(w[-1] for p in parts if len(w := _WORD.findall(p.split("=")[0])) > 1)


def _external(node, edge, who: str, target: str, name: str, line: int) -> None:
    node(target, "function", name, "", 0, None, True)
    edge(who, target, "calls", "EXTRACTED", line)


def _ghost(node, edge, who: str, name: str, path: str, line: int) -> None:
    node(f"unresolved::{name}", "function", name, path, 0, None, False)
    edge(who, f"unresolved::{name}", "calls", "AMBIGUOUS", line)


_NODE = pa.struct([("id", pa.string()), ("type", pa.string()), ("name", pa.string()), ("file", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("external", pa.bool_()), ("doc", pa.string()), ("deprecated", pa.bool_())])
_EDGE = pa.struct([("source", pa.string()), ("target", pa.string()), ("type", pa.string()), ("confidence", pa.string()), ("caller_line", pa.int32())])
_SQL = (
    "path string, nodes array<struct<id:string,type:string,name:string,file:string,start_line:int,end_line:int,external:boolean,doc:string,deprecated:boolean>>, "
    "edges array<struct<source:string,target:string,type:string,confidence:string,caller_line:int>>"
)


LANGUAGES = _LANG  # of an extension
EDGE_SCHEMA = "struct<source:string,target:string,type:string,confidence:string,caller_line:int>"
FRAGMENT_SCHEMA = _SQL


def fragments(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``path, nodes, edges`` of files ``(path, content)``, after the string columns ``keep``: parser output, one row per file, to be kept by content hash."""
    keys = [f.name for f in _NODE], [f.name for f in _EDGE]

    def run(batches):
        for b in batches:
            done = [parse(t, p) for p, t in zip(b.column("path").to_pylist(), b.column("content").to_pylist())]
            nodes = pa.array([[dict(zip(keys[0], r)) for r in f.nodes] for f in done], pa.list_(_NODE))
            edges = pa.array([[dict(zip(keys[1], r)) for r in f.edges] for f in done], pa.list_(_EDGE))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("path"), nodes, edges], [*keep, "path", "nodes", "edges"])

    ship(files.sparkSession)
    schema = "".join(f"{c} string, " for c in keep) + _SQL
    return spread(files.where("path is not null").select(*keep, "path", "content")).mapInArrow(run, schema)


def fragment_nodes(frags: DataFrame) -> DataFrame:
    """Rows of nodes with an ``ord`` by file and place in it: the order in which fragments merge."""
    rows = frags.select("path", F.posexplode("nodes").alias("k", "n"))
    return rows.select("n.*", F.struct("path", "k").alias("ord"))


def fragment_edges(frags: DataFrame) -> DataFrame:
    rows = frags.select("path", F.posexplode("edges").alias("k", "e"))
    return rows.select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.type").alias("relation"), "e.confidence", "e.caller_line", F.struct("path", "k").alias("ord"))
