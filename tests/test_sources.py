import json

import pytest

from codelattice.sources import code, files, texts
from codelattice.streaming import incremental


def test_ignore_rules(spark):
    paths = "a.ts src/b.ts src/node_modules/x.ts build/c.ts logs/d.md src/logs/e.md keep.md doc/deep/f.md tmp1.ts x/tmp2.ts secret.json".split()
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    rules = ["# comment", "", "/logs/", "doc/**", "!doc/deep/f.md", "tmp?.ts", "secret.*"]
    from pyspark.sql import functions as F

    assert {r["p"] for r in df.where(~files.ignored(F.col("p"), rules)).collect()} == {"a.ts", "src/b.ts", "src/logs/e.md", "keep.md", "doc/deep/f.md"}


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.ts").write_bytes(b"\xef\xbb\xbflet a\0 = 1")
    (tmp_path / "s/b.py").write_bytes("x = 'ü'".encode("utf-16"))
    (tmp_path / "s/c.exe").write_bytes(b"no")
    (tmp_path / "s/p.png").write_bytes(b"\x89PNG")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("x")
    df = files.scan_directory(spark, str(tmp_path))
    from pyspark.sql import functions as F

    got = {r["relative"]: r["t"] for r in df.select("relative", F.when(F.col("path").endswith("png"), None).otherwise(files.decode(F.col("bytes"))).alias("t")).collect()}
    assert got == {"s/a.ts": "let a = 1", "s/b.py": "x = 'ü'", "s/p.png": None}
    kinds = {r["name"]: (r["type"], r["extension"]) for r in files.file_nodes(df).collect()}
    assert kinds == {"a.ts": ("file", ".ts"), "b.py": ("file", ".py"), "p.png": ("media", ".png")}
    state = df.select("path", "size", "mtime_ms").withColumn("version", F.lit("1"))
    assert files.changed_files(df, state).count() == 0 and files.changed_files(df, state, "2").count() == 3


def test_configs_and_imports(spark):
    configs = {
        "/w/base.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"]}, "strict": true}}',
        "/w/app/tsconfig.json": '{ // c\n "extends": "../base", "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./*", "gen/*"], "@/deep/*": ["d/*"], "exact": ["one.ts"],},}, }',
        "/w/bad.json": "{", "/w/loop.json": '{"extends": "./loop"}',
    }
    assert files.read_config(configs, "/w/bad.json") == {} and files.read_config(configs, "/w/loop.json") == {"extends": "./loop"}
    assert files.read_config(configs, "/w/app/tsconfig.json")["compilerOptions"]["strict"] is True
    ali = spark.createDataFrame(files.alias_table({k: v for k, v in configs.items() if k.endswith("tsconfig.json") or k.endswith("base.json")}), "folder string, prefix string, position int, target string")
    f = spark.createDataFrame([(p,) for p in ("/w/app/src/a.ts", "/w/app/src/gen/b.tsx", "/w/app/src/d/x/index.ts", "/w/app/src/deep/y.ts", "/w/app/src/k.js")], "path string")
    imp = spark.createDataFrame([("/w/app/src/a.ts", s) for s in ("./k.js", "./gen/b", "@/b", "@/deep/x", "@/deep/y", "react", "../src/d/x")], "file string, specifier string")
    got = {r["specifier"]: r["resolved"] for r in files.resolve_imports(imp, f, ali).collect()}
    assert got == {"./k.js": "/w/app/src/k.js", "./gen/b": "/w/app/src/gen/b.tsx", "@/b": "/w/app/src/gen/b.tsx", "@/deep/x": "/w/app/src/d/x/index.ts", "@/deep/y": "/w/app/src/deep/y.ts", "../src/d/x": "/w/app/src/d/x/index.ts"}
    d = spark.createDataFrame([("/w/go.mod",), ("/w/app/src/go.mod",)], "path string")
    near = {r["path"]: r["descriptor"] for r in files.nearest_descriptor(spark.createDataFrame([("/w/app/src/d/z.go",), ("/w/q.go",), ("/v/q.go",)], "path string"), d).collect()}
    assert near == {"/w/app/src/d/z.go": "/w/app/src/go.mod", "/w/q.go": "/w/go.mod"}


def test_texts(spark):
    from pyspark.sql import functions as F

    md = spark.createDataFrame([("/r/doc/a.md", "see [x](./b.ts) and `c.ts` [y](../d.py#l1) `not it.` [x](./b.ts) [s](./a.md)", "n"), ("/r/n.md", None, "n"), ("/r/e.md", "", "n")], "path string, text string, name string")
    f = spark.createDataFrame([("/r/doc/b.ts",), ("/r/c.ts",), ("/r/d.py",), ("/r/doc/a.md",)], "path string")
    assert {tuple(r) for r in texts.markdown_links(md, f, "/r").collect()} == {("/r/doc/a.md", "/r/doc/b.ts"), ("/r/doc/a.md", "/r/c.ts")}  # a target with a fragment is no file
    odd = spark.createDataFrame([("/r/o.md", "[a [b] c](./b.ts) [two\nlines](./no) [x](./c\nd) `e.f\ng` ``h.i``", "n")], "path string, text string, name string")
    assert set(odd.select(texts.markdown_refs(F.col("text"))).first()[0]) == {"./b.ts", "./c\nd", "e.f\ng", "h.i"}
    assert [r[0] for r in md.select(texts.word_count(F.col("text"))).collect()][1:] == [0, 0]
    js = spark.createDataFrame([('{"a":1,"b":{"c":2}}',), ("[1,2,3]",), ("{bad",), (None,), ("{}",)], "t string")
    assert [r[0] for r in js.select(texts.json_key_count(F.col("t"))).collect()] == [2, 3, None, None, 0]
    pk = spark.createDataFrame([("/r/package.json", json.dumps({"dependencies": {"a": "1"}, "devDependencies": {"b": "1", "a": "2"}})), ("/r/other.json", '{"dependencies": {"z": "1"}}'), ("/q/package.json", "{")], "path string, text string")
    assert {r["dst"] for r in texts.package_imports(pk).collect()} == {"import::a", "import::b"}


def test_stored_graphs(spark, tmp_path):
    doc = {
        "version": "1", "nodes": [{"id": "a\\b", "type": "class", "name": "B", "file": "f"}, {"id": "a/b", "type": "file", "name": "second"}, {"id": "c", "type": "function"}],
        "edges": [{"source": "a\\b", "target": "c", "relation": "calls", "confidence": "X"}, {"source": "a/b", "target": "c", "type": "imports"}, {"source": "c", "target": "c"}, {"source": "c", "target": "gone"}],
        "analysis": {"communities": [{"id": 4, "members": ["a/b", "c"]}, {"id": 5, "nodes": ["c"]}]},
    }
    (tmp_path / "g.json").write_text(json.dumps(doc))
    g, part = texts.load_graph_json(spark, str(tmp_path / "g.json"))
    assert {r["id"]: r["name"] for r in g.nodes.collect()} == {"a/b": "B", "c": None} and [r["relation"] for r in g.edges.orderBy("ord").collect()] == ["calls", "imports"]
    assert {tuple(r) for r in part.collect()} == {("a/b", 4), ("c", 5)}
    doc["nodes"][0] |= {"keyCount": 3, "startLine": 7, "external": True}
    doc["edges"][0]["callerLine"] = 9
    (tmp_path / "h.json").write_text(json.dumps(doc))
    g, part = texts.load_graph_json(spark, str(tmp_path / "h.json"))
    b = {r["id"]: r for r in g.nodes.collect()}["a/b"]
    assert b["meta"] == {"keyCount": "3"} and b["start_line"] == 7 and b["external"] is True and g.edges.orderBy("ord").first()["meta"] == {"callerLine": "9"}
    texts.export_graph_document(g, str(tmp_path / "doc"), part)
    again, parts = texts.load_graph_json(spark, str(tmp_path / "doc"))
    assert {r["id"]: (r["name"], r["start_line"]) for r in again.nodes.collect()} == {r["id"]: (r["name"], r["start_line"]) for r in g.nodes.collect()}
    assert [(r["src"], r["dst"], r["relation"]) for r in again.edges.orderBy("ord").collect()] == [(r["src"], r["dst"], r["relation"]) for r in g.edges.orderBy("ord").collect()] and parts.count() == 2
    texts.export_graph_document(texts.load_graph_json(spark, str(tmp_path / "doc"))[0].__class__(g.nodes.limit(0), g.edges.limit(0)), str(tmp_path / "none"))
    assert texts.load_graph_json(spark, str(tmp_path / "none"))[0].nodes.count() == 0
    texts.save_graph(g, str(tmp_path / "store"))
    back = texts.load_graph(spark, str(tmp_path / "store"))
    assert {str(r) for r in back.edges.collect()} == {str(r) for r in g.edges.collect()} and back.nodes.count() == 2
    texts.export_graph_json(g, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/edges")).count() == 2


SOURCES = {
    "/p/a.ts": "import { x as y, z } from './lib';\nimport fs from 'node:fs';\nexport class Outer extends Base {\n  inner(a: number): void {\n    y(a); this.other(); missing(); helper();\n  }\n  other() { return new Kind(); }\n}\ninterface Kind {}\nfunction helper() { fs.read(); }\n// notCalled()\nconst s = 'alsoNot()';\n",
    "/p/b.py": "import os\nfrom pkg.mod import name as alias\n\nclass A:\n    def m(self):\n        alias()\n        self.n()\n        os.walk('x')\n    def n(self):\n        unknown_fn()\n\ndef top():\n    def nested(): pass\n    nested()\n",
    "/p/c.go": 'package c\n\nimport (\n\tfm "fmt"\n\t"a/b/util"\n)\n\ntype T struct {\n}\n\ntype I interface{}\n\nfunc (t *T) Run(x int) int {\n\tutil.Do(x)\n\treturn helper(x)\n}\n\nfunc helper(x int) int { return x }\n',
    "/p/d.rs": "use a::b::{c, d as e};\n\npub struct S { }\nimpl S {\n    pub fn go(&self) -> u8 { c(1); e(); local() }\n}\nfn local() -> u8 { 1 }\nmacro_rules! mac {\n}\n",
    "/p/E.java": "package p;\nimport java.util.Foo;\npublic class E {\n    private int f(String a) { return g(a); }\n    int g(String a) { Foo.make(); return 1; }\n    enum K { A }\n}\n",
    "/p/f.cpp": "#include <vector>\nnamespace n {\nclass C {\n  int m(int a) { return free_fn(a); }\n};\nint free_fn(int a) {\n  return a;\n}\n}\n",
    "/p/broken.py": "def ok(:\n  x = (\nclass Z:\n    def q(self): pass\n", "/p/none.txt": "x", "/p/empty.ts": "", "/p/null.go": None,
}


def test_extractors(spark):
    f = {p: code.parse(t, p) for p, t in SOURCES.items()}
    ids = lambda p: {n[0].removeprefix(p): n[1] for n in f[p].nodes if n[0].startswith(p + "::")}
    edges = lambda p: {(a.replace(p, ""), b.replace(p, ""), k, c) for a, b, k, c, _ in f[p].edges}
    assert ids("/p/a.ts") == {"::Outer": "class", "::Outer.inner": "function", "::Outer.other": "function", "::Kind": "interface", "::helper": "function"}
    ts = edges("/p/a.ts")
    assert {("::Outer.inner", "./lib::x", "calls", "EXTRACTED"), ("::Outer.inner", "::Outer.other", "calls", "EXTRACTED"), ("::Outer.inner", "unresolved::missing", "calls", "AMBIGUOUS"), ("::Outer.inner", "::helper", "calls", "EXTRACTED"), ("", "::Outer", "defines", "EXTRACTED"), ("::Outer", "::Outer.inner", "defines", "EXTRACTED"), ("", "import::./lib", "imports", "EXTRACTED")} <= ts
    assert not any("notCalled" in b or "alsoNot" in b for _, b, _, _ in ts) and ("::Outer.other", "::Kind", "references", "EXTRACTED") in ts or ("::Outer.other", "::Kind", "calls", "EXTRACTED") in ts
    assert ids("/p/b.py") == {"::A": "class", "::A.m": "function", "::A.n": "function", "::top": "function", "::top.nested": "function"}
    assert {("::A.m", "import::pkg.mod::name", "calls", "EXTRACTED"), ("::A.n", "unresolved::unknown_fn", "calls", "AMBIGUOUS"), ("::top", "::top.nested", "defines", "EXTRACTED")} <= edges("/p/b.py")
    assert not any("os" in b.split("::") or "fs" in b.split("::") or "import" == b for p in f for _, b, _, _ in edges(p))  # standard libraries are no nodes
    assert ids("/p/c.go") == {"::T": "struct", "::I": "interface", "::T.Run": "function", "::helper": "function"}
    assert {("::T", "::T.Run", "defines", "EXTRACTED"), ("::T.Run", "::helper", "calls", "EXTRACTED"), ("::T.Run", "import::a/b/util::Do", "calls", "EXTRACTED")} <= edges("/p/c.go")
    assert ids("/p/d.rs") == {"::S": "struct", "::S.go": "function", "::local": "function", "::mac": "macro"}
    assert {("::S", "::S.go", "defines", "EXTRACTED"), ("::S.go", "import::a::b::c::c", "calls", "EXTRACTED"), ("::S.go", "import::a::b::d::d", "calls", "EXTRACTED"), ("::S.go", "::local", "calls", "EXTRACTED")} <= edges("/p/d.rs")
    assert ids("/p/E.java") == {"::E": "class", "::E.f": "function", "::E.g": "function", "::E.K": "enum"} and ("::E.f", "::E.g", "calls", "EXTRACTED") in edges("/p/E.java")
    assert ids("/p/f.cpp") == {"::n.C": "class", "::n.C.m": "function", "::n.free_fn": "function"} and ("::n.C.m", "::n.free_fn", "calls", "EXTRACTED") in edges("/p/f.cpp")
    assert "::Z" in ids("/p/broken.py") and all(len(f[p].nodes) == 1 for p in ("/p/none.txt", "/p/empty.ts", "/p/null.go"))
    df = spark.createDataFrame([(p, t, "x") for p, t in SOURCES.items()] + [(None, "x", "x")], "path string, content string, nodes string")
    fr = code.fragments(df)
    assert fr.count() == len(SOURCES) and code.fragment_edges(fr).count() == sum(len(x.edges) for x in f.values()) and code.fragment_nodes(fr).count() == sum(len(x.nodes) for x in f.values())
    assert code.fragments(df.limit(0)).count() == 0
    assert len(code.parse("function f() {" + "{" * 200_000, "/l.ts").nodes) == 2


def test_incremental_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    def put(k, rows):
        spark.createDataFrame(rows, incremental.FILE_SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        q = incremental.watch_files(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp"), lambda d: d.select("path", F.length("content").alias("n")))
        q.awaitTermination()
        assert q.exception() is None

    put(0, [("/a", 3, 1.0, "h", "abc"), ("/a", 4, 2.0, "h", "abcd"), ("/b", 1, 1.0, "h", "x")])
    run()
    put(1, [("/a", 4, 2.0, "h", "abcd"), ("/b", 2, 5.0, "h", "xy"), (None, 1, 1.0, "h", "x")])
    run()
    frag = spark.read.parquet(str(tmp_path / "store/fragments"))
    assert sorted((r["path"], r["n"]) for r in frag.collect()) == [("/a", 4), ("/b", 1), ("/b", 2)]
    assert incremental.current_fragments(spark, str(tmp_path / "store")).groupBy("path").count().where("count > 1").count() == 0
    assert {r["path"] for r in incremental.current_fragments(spark, str(tmp_path / "store")).collect()} == {"/a", "/b"}
    state = incremental.newest_versions(spark.read.parquet(str(tmp_path / "store/state")).drop("batch"))
    assert {r["path"]: r["size"] for r in state.collect()} == {"/a": 4, "/b": 2}
    s = spark.createDataFrame([("/a", 1, 1.0, "h", "x")], incremental.FILE_SCHEMA)
    assert {r["path"]: r["size"] for r in incremental.upsert(s, spark.createDataFrame([("\\a", 9, 3.0, "h", "y"), ("/c", None, None, None, None)], incremental.FILE_SCHEMA)).collect()} == {"/a": 9, "/c": None}


@pytest.fixture(scope="module")
def session(spark):
    from codelattice.api import Session
    from codelattice.plans.graph_queries import stored

    return Session(stored(spark, "/root/testdata/sf0.001"))


def test_api(session):
    assert session.search("emit").count() > 0 and session.node("falconstack/core::emit").count() == 1
    assert session.neighbors("falconstack/core::emit").count() == 20 and session.god_nodes(2, 5).count() == 5
    text = session.path("falconstack/core::emit", "wharfloom::useStore")
    assert text.startswith("Shortest path (") and "<--calls [" in text
    assert session.neighbors("emit", "in", "function").count() > 0  # the type picks the symbol, not its neighbours
    text = session.query("useStore emit", "bfs", 2, 100)
    assert text.startswith("Traversal: BFS depth=2 | Start: [") and text.endswith("(truncated to ~100 token budget)") and len(text.split("\n...")[0]) == 300
    assert session.query("useStore emit", "dfs", 1).startswith("Traversal: DFS depth=1")
    assert "EXTRACTED" in session.stats() and session.report().startswith("# Graph report")
    name = session.communities.groupBy("community").count().orderBy("count", ascending=False).first()["community"]
    assert session.community(name).count() > 0 and session.surprises().count() >= 0


def test_modules(spark):
    paths = ["/w/p/a.py", "/w/p/util/b.py", "/w/p/pkg/__init__.py", "/v/util/b.py", "/w/j/x/Foo.java", "/w/r/src/net/mod.rs", "/w/r/src/net/io.rs", "/w/c/inc/h.hpp", "/w/g/core/z.go", "/w/g/core/a.go"]
    f = spark.createDataFrame([(p,) for p in paths], "path string")
    want = {
        ("/w/p/a.py", "util.b", "py"): "/w/p/util/b.py", ("/w/p/a.py", ".pkg", "py"): "/w/p/pkg/__init__.py", ("/v/q.py", "util.b", "py"): "/v/util/b.py", ("/w/j/Z.java", "x.Foo", "java"): "/w/j/x/Foo.java",
        ("/w/r/src/m.rs", "crate::net::io::Read", "rs"): "/w/r/src/net/io.rs", ("/w/r/src/m.rs", "crate::net", "rs"): "/w/r/src/net/mod.rs", ("/w/c/m.cpp", "inc/h.hpp", "cpp"): "/w/c/inc/h.hpp", ("/w/g/m.go", "ex.org/g/core", "go"): "/w/g/core/a.go",
        ("/w/p/a.py", "os", "py"): None, ("/w/c/m.cpp", "vector", "cpp"): None,
    }
    imp = spark.createDataFrame(list(want), "file string, specifier string, lang string")
    got = {(r["file"], r["specifier"]): r["resolved"] for r in files.resolve_modules(imp, f).collect()}
    assert got == {k[:2]: v for k, v in want.items() if v}
    e = spark.createDataFrame(
        [("/w/p/a.py", "/w/p/a.py", "import::util.b", "imports"), ("/w/p/a.py", "/w/p/a.py::f", "import::util.b::go", "calls"), ("/w/p/a.py", "/w/p/a.py::f", "import::os::walk", "calls"), ("/w/p/a.py", "/w/p/a.py::f", "unresolved::x", "calls")],
        "path string, source string, target string, type string",
    )
    linked = {r["target"] for r in files.link_imports(e, files.resolve_modules(imp, f)).collect()}
    assert linked == {"/w/p/util/b.py", "/w/p/util/b.py::go", "import::os::walk", "unresolved::x"}


def test_views(spark):
    from codelattice.model import Graph
    from codelattice.operators import view as V

    n = spark.createDataFrame([("a", 0, "class", "Ab", "/x/ab.ts"), ("b", 1, "intent", None, None), ("c", 2, None, "zab", "")], "id string, ord long, type string, name string, file string")
    e = spark.createDataFrame([("b", "a", "explains", "X", 0), ("c", "a", "calls", "X", 1), ("c", "a", "imports", "X", 2)], "src string, dst string, relation string, confidence string, ord long")
    p = spark.createDataFrame([("a", "k")], "id string, community string")
    g = Graph(n, e)
    assert {r["id"] for r in V.visible(n, p, ["intent"], []).collect()} == {"a", "c"} and {r["id"] for r in V.visible(n, p, [], ["k"]).collect()} == {"b", "c"}
    assert [(r["id"], r["score"]) for r in V.suggestions(g, "AB").collect()] == [("a", 1000.03), ("c", 1.02)]
    assert [(r["id"], r["relation"]) for r in V.neighbour_list(g, "a", "in", n).collect()] == [("b", "explains"), ("c", "calls"), ("c", "imports")]
    assert [tuple(r) for r in V.legend(p).collect()] == [(0, "k", 1, 0.0)]


DOCS = {
    "a.ts": ("// one\n/** Two. @see ./b {@link Foo}\n * @deprecated */\nexport function f() {}\n\nconst x = 1;\nfunction g() {}\n", {"f": "// one\n/** Two. @see ./b {@link Foo}\n * @deprecated */", "g": None}),
    "a.py": ("def f(a, b=(1, 2)) -> int:  # c\n    \"\"\"Doc f.\n\n    More.\n    \"\"\"\n    return 1\n\nclass K:\n    'Doc K.'\n    def g(self): return 'no'\n", {"f": "Doc f.\n\n    More.", "K": "Doc K.", "K.g": None}),
    "a.go": ("package a\n\n// F sums.\n// Twice.\nfunc F() {}\n\n/* T is. */\ntype T struct {\n}\n", {"F": "F sums.\nTwice.", "T": "T is."}),
    "A.java": ("/**\n * Doc A.\n *\n * More.\n */\n@Anno(x = 1)\npublic class A {\n  // plain\n  void f(int a) { }\n}\n", {"A": "Doc A.\nMore.", "A.f": None}),
    "a.rs": ("// no\n/// Doc f.\n/// More.\n#[inline]\npub fn f() {}\n", {"f": "Doc f.\nMore."}),
    "a.cpp": ("// Doc f.\ntemplate <class T>\nint f(T a) {\n  return 1;\n}\n", {"f": "Doc f."}),
}


@pytest.mark.parametrize("name", sorted(DOCS))
def test_docs_of_symbols(name):
    text, want = DOCS[name]
    frag = code.parse(text, "/" + name)
    assert {n[0].split("::")[1]: n[7] for n in frag.nodes if n[0].startswith("/" + name + "::")} == want
    if name == "a.ts":
        assert {(a, b) for a, b, k, _, _ in frag.edges if k == "explains"} == {("/a.ts::f", "./b"), ("/a.ts::f", "Foo")}
        assert {n[0]: n[8] for n in frag.nodes}["/a.ts::f"] is True


SHADOWS = [
    ("a.ts", "import { p } from './p';\nfunction f(cb: any) {\n  const { k } = cb;\n  cb(); k(); p(); free();\n}\nlet top = 1;\nfunction g() { top(); }\n", {"./p::p", "unresolved::free"}),
    ("a.py", "def f(cb, x=None):\n    k = cb\n    for e in x:\n        e()\n    with open(k) as w:\n        w()\n    cb(); k(); free()\n", {"unresolved::free"}),
    ("a.go", "package a\n\nfunc F(cb func()) {\n\tk := cb\n\tcb()\n\tk()\n\tfree()\n}\n", {"unresolved::free"}),
    ("A.java", "class A {\n  void f(Run cb) {\n    Run k = cb;\n    cb(); k(); free();\n  }\n}\n", {"unresolved::free"}),
    ("a.rs", "fn f(cb: F) {\n    let k = cb;\n    cb(); k(); free();\n}\n", {"unresolved::free"}),
    ("a.cpp", "void f(F cb) {\n  auto k = cb;\n  cb(); k(); free_it();\n}\n", {"unresolved::free_it"}),
]


@pytest.mark.parametrize("name,text,want", SHADOWS)
def test_variables_and_built_ins_are_no_targets(name, text, want):
    assert {b for _, b, k, _, _ in code.parse(text, "/" + name).edges if k == "calls"} == want


def test_receivers_and_standard_libraries():
    ts = "import api from 'api-kit';\nimport path from 'path';\nfunction f() {\n  api.users.list().then(go).save();\n  path.posix.join(a);\n  JSON.parse(x);\n  [1].map(g);\n  arr.push(1);\n}\n"
    assert {b for _, b, k, _, _ in code.parse(ts, "/a.ts").edges if k == "calls"} <= {"api-kit::list", "api-kit::save", "unresolved::go"}
    assert ("/a.ts::f", "api-kit::list") in {(a, b) for a, b, *_ in code.parse(ts, "/a.ts").edges}
    rs = "fn f() { std::fs::read(x); HashMap::new(); other::run(); }\n"
    assert {b for _, b, k, _, _ in code.parse(rs, "/a.rs").edges if k == "calls"} == {"unresolved::run"}
    from codelattice.sources.names import is_standard

    assert is_standard("node:fs/promises", "ts") and not is_standard("./fs", "ts") and is_standard("os.path", "py") and is_standard("java.util.List", "java") and is_standard("std::io", "rs")
    assert is_standard("vector", "cpp") and is_standard("own.h", "cpp", True) and not is_standard("own.h", "cpp") and is_standard("net/http", "go") and not is_standard("github.com/a/b", "go")
