import pytest

from codelattice.llm.docpairs import describing_sentences, documented_functions, function_pairs, parse_functions

TRIVIAL = [
    "", " \n ", "resolveFrame", "Resolves the frame.", "resolveFrame(): resolve the given frame.", "Function resolveFrame", "This function resolves the frame.", "Method to resolve a frame", "/**\n * Resolve frame\n */",
    "@param x the one\n@returns", ":param x:\n:return:", "Args:\n    x:\n    y: the y\nReturns:\n    z", "TODO: document", "FIXME write docs", "XXX", "TODO", "N/A", "...", "tbd", "Description.", "+-+-+-+\n+-+-+-+", "nolint:errcheck",
    "eslint-disable-next-line no-shadow", "type: ignore", "@ts-ignore", "clang-format off", "Copyright (c) 2015 the x authors. All rights reserved.\nUse of this source is governed by the terms in NOTICE\nat the top.",
    "Auto-generated method stub", "Default constructor stub.", "Created by the editor template.", "see above", "same as the other one", "{@inheritDoc}", "See {@link Foo#bar}.", "if (x != null) fetch(a, b, 3);\nint y = bind(c, d, 4);",
    "assert a < b, (c, d, 1)\ne.append(f[g + h:2])", "Obvious.", "helper", "(no comment)", "@deprecated since 3.7, call other instead",
]
TELLING = [
    "Never blocks on the frame.", "Bytes, not characters.", "At most 553 per edge.", "Idempotent; safe during a rebuild.", "Resolves the frame.\nRaises when two frames claim one slot.", "Stable across restarts.",
    "Devuelve una copia, por lo que el llamador puede modificarla.", "Gibt null zurück, wenn der Eintrag fehlt.", "Same as passing --no-cache and -j 4 on the command line.", "/**\n * Ties are broken by order.\n * @param x the x\n */",
    "TODO: measure\nOlder clients send it without a tag; those get none.", "Returns an empty list when nothing was seen.",
]


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial(doc):
    assert describing_sentences(doc, "resolveFrame") == []


@pytest.mark.parametrize("doc", TELLING)
def test_telling(doc):
    assert describing_sentences(doc, "resolveFrame")


def test_islands():
    py = 'import a\n\nclass C:\n    @wraps\n    def run(self, x):\n        """Does it."""\n        return x\n\n    def next(self): pass\n'
    assert [(n, a, b, d) for n, a, b, d, _, _ in parse_functions(py, "py")] == [("run", 5, 7, "Does it."), ("next", 9, 9, "")]
    ts = "// about f\nexport function f(a: string): void {\n  if (a) { g('}'); } // }\n}\nclass K {\n  /** m */\n  m(x: number): number { return x; }\n}\nconst h = (a) => {\n};\n"
    assert [(n, a, b) for n, a, b, *_ in parse_functions(ts, "ts")] == [("f", 2, 4), ("m", 7, 7), ("h", 9, 10)]
    go = "// Sums.\nfunc (r *R) Sum(a []int) int {\n\treturn 1\n}\n"
    assert [(f[0], f[1], f[2], f[3]) for f in parse_functions(go, "go")] == [("Sum", 2, 4, "// Sums.")]
    rs = "impl A {\n    /// Doc.\n    #[inline]\n    pub fn go(&self) -> u8 {\n        1\n    }\n}\n"
    assert [(f[0], f[1], f[2], f[3]) for f in parse_functions(rs, "rs")] == [("go", 4, 6, "/// Doc.")]
    java = "class A {\n    public int sum(String a, int b) {\n        return f(b);\n    }\n}\n"
    assert [(f[0], f[1], f[2]) for f in parse_functions(java, "java")] == [("sum", 2, 4)]
    cpp = "int sum(const std::string& a, int b) {\n  if (a < b) c = 1;\n  return 0;\n}\n"
    assert [(f[0], f[1], f[2]) for f in parse_functions(cpp, "cpp")] == [("sum", 1, 4)]
    assert parse_functions(None, "py") == [] and parse_functions("x", "zz") == [] and parse_functions("function f() {" + "{" * 100_000, "ts")


NODE = "ord long, id string, type string, name string, file string, start_line int, end_line int, doc string, scanned_at timestamp_ntz, description string"


def test_current_row_and_pairs(spark):
    from datetime import datetime as dt

    d1, d2 = dt(2024, 1, 1), dt(2024, 2, 1)
    rows = [
        (1, "/a.ts::f", "function", "f", "/a.ts", 2, None, "Never blocks.", d1, "x"), (2, "\\a.ts::f", "function", "f", "\\a.ts", 2, None, "f", d2, "x"),
        (3, "/a.ts::g", "function", "g", "/a.ts", 9, None, "f", d1, "x"), (4, "/a.ts::g", "function", "g", "/a.ts", 5, None, "Stable across restarts.", d1, "x"),
        (5, "/a.ts::K", "class", "K", "/a.ts", 5, None, "Stable across restarts.", d1, "x"), (6, None, "function", "z", None, None, None, "Never blocks.", d1, None),
        (7, "/a.ts::q", "function", None, None, None, None, "Never blocks.", None, None),
    ]
    nodes = spark.createDataFrame(rows, NODE)
    none = spark.createDataFrame([], "path string, mtime_ms double, content string, name string")
    assert {r["id"] for r in documented_functions(nodes, none).collect()} == {"/a.ts::g", "/a.ts::q"}
    src = "// x\nfunction f() {\n}\n\nfunction g(a) {\n  return 1;\n}\nfunction g(b) {\n}\n"
    files = spark.createDataFrame([("/a.ts", 2.0, src, "n"), ("/a.ts", 1.0, "function g() {\n}", "n"), ("/b.ts", None, None, "n")], "path string, mtime_ms double, content string, name string")
    assert [(r["id"], r["signature"]) for r in function_pairs(nodes, files).collect()] == [("/a.ts::g", "function g(a) {")]
    assert documented_functions(nodes.limit(0), files).count() == 0 and function_pairs(nodes, files.limit(0)).count() == 0


FORMS = [
    ("rs", "fn f<T: Into<String>>(x: T) {\n    g();\n}"), ("rs", "pub fn f<F: Fn(u8) -> bool>(x: F) -> Vec<[u8; 4]>\nwhere\n    F: Copy,\n{\n}"),
    ("java", "public Map<String, Integer> f(int a) {\n}"), ("java", "static <T extends Comparable<T>> T f(T a) {\n}"), ("java", '@Override @A(names = {"x", "y"}) public int f(@B(1) int a) throws E {\n}'),
    ("java", "public Map<String, List<Integer>> f(\n    Map<String, Integer> a,\n    int b\n) {\n}"),
    ("ts", "const f = (cb: () => void) => {\n};"), ("ts", "export const f = async (\n  a: number,\n  b = g(1),\n): Promise<void> => {\n};"), ("ts", "const f = (a) => a + 1;"), ("ts", "const f = a =>\n  g(a)\n    .h();"),
    ("ts", "const f: (a: X) => void = (a) => {\n};"), ("ts", "  f(cb: () => void): { a: number } {\n  }"), ("ts", "function f<T extends Map<string, X>>(a: T): void {\n}"),
    ("cpp", "Foo::f(int a) : a_(a), b_{1} {\n}"), ("cpp", "std::map<std::string, int> f(const std::vector<int>& a) const {\n}"), ("go", "func f[K comparable, V []int](a map[K]V) (int, error) {\n}"), ("go", "func f(a func(int) int) interface{} {\n}"),
]


@pytest.mark.parametrize("ext,form", FORMS)
def test_signatures_of_every_form(ext, form):
    text = "\n// Doc.\n" + form + "\n\n"
    got = [x for x in parse_functions(text, ext) if x[0] == "f"]
    assert [(n, a, d) for n, a, _, d, _, _ in got] == [("f", 3, "// Doc.")]
    assert got[0][5].rstrip("\n; ") == form.rstrip("; ")


def test_constructors_and_calls():
    cpp = "struct Foo {\n  Foo(int a) : a_(a), b_{a} {\n    run(a);\n  }\n  explicit Foo(X<int> a) noexcept : a_(a.x()) { if (a) { } }\n};\n"
    assert [x[:3] for x in parse_functions(cpp, "cpp")] == [("Foo", 2, 4), ("Foo", 5, 5)]
    java = "class A {\n  A(int a) {\n    if (a) { run(() -> { }); }\n    new B() { };\n    return new C(a) { };\n  }\n}\n"
    assert [x[:3] for x in parse_functions(java, "java")] == [("A", 2, 6)]
    assert [x[0] for x in parse_functions("run(a, () => {\n  g();\n});\nif (a) {\n}\nconst x = 5;\nconst y = [1].map((a) => a);\n", "ts")] == []


def test_namesakes_are_not_paired_with_each_other(spark, monkeypatch):
    from codelattice.llm import docpairs

    n = 600
    src = "".join(f"class C{k} {{\n  run(a) {{ return {k}; }}\n}}\n" for k in range(n))
    rows = [(k, f"/m.ts::C{k}.run", "function", "run", "/m.ts", 3 * k + 2 + (k % 5 == 0), None, f"Never blocks on {k}.", None, "x") for k in range(n)]
    nodes = spark.createDataFrame(rows, NODE)
    files = spark.createDataFrame([("/m.ts", 2.0, src, "n")] * 2 + [("/m.ts", 3.0, "", "n")][:0], "path string, mtime_ms double, content string, name string")
    sizes, keep = [], docpairs.cut
    monkeypatch.setattr(docpairs, "cut", lambda df: (sizes.append((out := keep(df)).count()), out)[1])
    got = function_pairs(nodes, files).collect()
    assert len(got) == n and all(f"return {r['id'].split('C')[1].split('.')[0]};" in r["code"] for r in got)
    assert max(sizes) <= 2 * (n + 1)  # no join has more rows than the islands


def test_newest_version_without_functions(spark):
    nodes = spark.createDataFrame([(1, "/a.ts::f", "function", "f", "/a.ts", 1, None, "Never blocks.", None, "x")], NODE)
    files = spark.createDataFrame([("/a.ts", 1.0, "function f() {\n}"), ("/a.ts", 2.0, "const x = 1;")], "path string, mtime_ms double, content string")
    assert function_pairs(nodes, files).count() == 0


def test_islands_decide_what_is_documented(spark):
    rows = [(k, f"/a.ts::{n}", "function", n, "/a.ts", line, None, "Never blocks on it.", None, "x") for k, (n, line) in enumerate([("f", 2), ("g", 5), ("h", 9)])]
    nodes = spark.createDataFrame(rows, NODE)
    text = "/** Never blocks on it. */\nfunction f() {\n}\n// TODO\nfunction g() {\n}\n"
    files = spark.createDataFrame([("/a.ts", 2.0, text), ("/a.ts", 1.0, "\nfunction f() {\n}\n"), (None, 1.0, "x"), ("/b.ts", None, None)], "path string, mtime_ms double, content string")
    # f by its island in the newest version; g's island tells nothing; h has none, so its own doc decides
    assert {r["id"] for r in documented_functions(nodes, files).collect()} == {"/a.ts::f", "/a.ts::h"}
