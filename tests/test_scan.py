import json

import pytest
from pyspark.sql import functions as F

from codelattice import scan as S
from codelattice.sources import code

FILES = {
    "src/main.ts": "import { load } from './lib/load';\nimport ext from 'ext-kit';\nimport fs from 'fs';\n/** Starts. @see ./lib/load */\nexport function main(x: number) {\n  load(x); ext.run(); helper(); nowhere();\n}\n",
    "src/lib/load.ts": "import { deep } from '@/deep';\nexport function load(y: number) {\n  deep(y);\n}\n",
    "src/deep.ts": "export function deep(z: number) { return z; }\nfunction helper() { return 1; }\n",
    "tsconfig.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./*"]}}}',
    "package.json": '{"name": "x", "dependencies": {"ext-kit": "1"}, "devDependencies": {"tool": "2"}}',
    "docs/readme.md": "See [main](../src/main.ts) and `src/deep.ts` and [gone](./no.md).\n",
    "pkg/a.py": "import os\nfrom pkg.b import run\n\ndef go():\n    '''Goes.'''\n    run()\n",
    "pkg/__init__.py": "VERSION = 1\n\ndef hidden(): pass\n", ".tool/conf.js": "function conf() {}", "pkg/b.py": "def run():\n    pass\n",
    "logo.png": "x", "skip/x.ts": "function no() {}", ".gitignore": "skip/\n",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in FILES.items():
        p = tmp_path / "w" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path


def links(g, root):
    return {(r["src"].replace(root + "/", ""), r["dst"].replace(root + "/", ""), r["relation"]) for r in g.edges.collect()}


def test_scan_from_folder_to_stored_graph(spark, tree, monkeypatch):
    root, store = str(tree / "w"), str(tree / "store")
    g = S.scan(spark, root, store)
    got = links(g, root)
    assert {
        ("src/main.ts", "src/lib/load.ts", "imports"), ("src/lib/load.ts", "src/deep.ts", "imports"), ("src/main.ts", "import::ext-kit", "imports"), ("package.json", "import::tool", "imports"),
        ("src/main.ts::main", "src/lib/load.ts::load", "calls"), ("src/lib/load.ts::load", "src/deep.ts::deep", "calls"), ("src/main.ts::main", "src/deep.ts::helper", "calls"),
        ("src/main.ts::main", "unresolved::nowhere", "calls"), ("src/main.ts::main", "src/lib/load.ts", "explains"), ("docs/readme.md", "src/main.ts", "explains"), ("docs/readme.md", "src/deep.ts", "explains"),
        ("pkg/a.py", "pkg/b.py", "imports"), ("pkg/a.py::go", "pkg/b.py::run", "calls"), ("src/main.ts", "src/main.ts::main", "defines"),
    } <= got
    assert ("pkg/__init__.py", "pkg/__init__.py::hidden", "defines") in got and (".tool/conf.js", ".tool/conf.js::conf", "defines") in got
    assert not any("skip" in x or "no.md" in x or "import::fs" in x or "import::os" in x for a, b, _ in got for x in (a, b))
    nodes = {r["id"].replace(root + "/", ""): r for r in g.nodes.collect()}
    assert nodes["docs/readme.md"]["meta"]["wordCount"] == "6" and nodes["package.json"]["meta"]["keyCount"] == "3" and nodes["logo.png"]["type"] == "media" and nodes["logo.png"]["meta"]["size"] == "1"
    assert nodes["pkg/a.py::go"]["doc"] == "Goes." and nodes["src/main.ts::main"]["doc"].startswith("/** Starts.") and "./lib/load::load" not in nodes
    assert nodes["src/deep.ts::deep"]["degree"] == 2 and nodes["src/deep.ts::deep"]["indeg"] == 2

    parsed, keep = [], code.fragments
    monkeypatch.setattr(code, "fragments", lambda df, **k: (parsed.append({r["path"].replace(root + "/", "") for r in df.collect()}), keep(df, **k))[1])
    assert links(S.scan(spark, root, store), root) == got and parsed.pop() == set()  # all fragments come from the store
    (tree / "w/src/deep.ts").write_text("export function deep(z: number) { return z; }\n")
    again = links(S.scan(spark, root, store), root)
    assert parsed.pop() == {"src/deep.ts"} and ("src/main.ts::main", "unresolved::helper", "calls") in again
    S.scan(spark, root, store, force=True)
    assert "src/main.ts" in parsed.pop()


def test_history_of_a_scan(spark, tree):
    root, store = str(tree / "w"), str(tree / "store")
    h = [c * 40 for c in "abc"]
    blame = spark.createDataFrame([(f"{root}/src/deep.ts", 1, h[0]), (f"{root}/src/deep.ts", 2, h[1]), (f"{root}/src/main.ts", 6, h[2]), (f"{root}/src/main.ts", 5, "0" * 40)], "file string, line int, hash string")
    commits = spark.createDataFrame([(x, "me", f"2024-01-0{k + 1}", f"Message {k}\nmore") for k, x in enumerate(h[:2])], "hash string, author string, commit_date string, message string")
    g = S.scan(spark, root, store, S.History(blame, commits))
    want = {(f"commit::{h[0]}", "src/deep.ts", "explains"), (f"commit::{h[0]}", "src/deep.ts::deep", "explains"), (f"commit::{h[1]}", "src/deep.ts", "explains"), (f"commit::{h[1]}", "src/deep.ts::helper", "explains")}
    assert {x for x in links(g, root) if x[0].startswith("commit::")} == want  # a hash without metadata is skipped
    more = commits.unionByName(spark.createDataFrame([(h[2], "you", "2024-02-01", "Late")], commits.schema))
    g = S.scan(spark, root, store, S.History(blame, more))
    want |= {(f"commit::{h[2]}", "src/main.ts", "explains"), (f"commit::{h[2]}", "src/main.ts::main", "explains")}
    assert {x for x in links(g, root) if x[0].startswith("commit::")} == want
    assert spark.read.parquet(f"{store}/commits").count() == 3 and spark.read.parquet(f"{store}/blame").where("hash is not null").count() == 6


def test_projects(spark, tmp_path):
    from codelattice.sources import files

    for name, text in {
        "go.mod": "// x\nmodule ex.org/top\n", "svc/go.mod": "module ex.org/top/svc", "a/b/c/d/e/go.mod": "module too.deep", "node_modules/go.mod": "module no", "kit/Cargo.toml": '[package]\nversion = "1"\nname = "my_kit"\n', "bad/Cargo.toml": "[lib]\n",
        "util/z.go": "", "util/y.go": "", "svc/util/s.go": "", "main.go": "", "kit/src/lib.rs": "", "kit/src/net/io.rs": "", "kit/src/net/mod.rs": "", "app/src/main/java/p/A.java": "", "app/src/x.java": "",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    root = str(tmp_path)
    found = files.find_projects(spark, root)
    assert {(r["kind"], r["folder"].removeprefix(root), r["name"]) for r in found.collect()} == {("go.mod", "", "ex.org/top"), ("go.mod", "/svc", "ex.org/top/svc"), ("Cargo.toml", "/kit", "my_kit")}
    paths = spark.createDataFrame([(str(p),) for p in tmp_path.rglob("*.*") if p.suffix in (".go", ".rs", ".java")], "path string")
    asked = {("go", "ex.org/top/util"): "/util/y.go", ("go", "ex.org/top/svc/util"): "/svc/util/s.go", ("go", "ex.org/other"): None, ("rs", "my_kit::net::io::Read"): "/kit/src/net/io.rs", ("rs", "my_kit::net::Thing"): "/kit/src/net/mod.rs", ("rs", "my_kit::Top"): "/kit/src/lib.rs"}
    imp = spark.createDataFrame([(f"{root}/main.go", s, k) for k, s in asked], "file string, specifier string, lang string")
    got = {r["specifier"]: r["resolved"].removeprefix(root) for r in files.resolve_projects(imp, found, paths).collect()}
    assert got == {s: v for (_, s), v in asked.items() if v}
    assert {r["folder"].removeprefix(root) for r in files.java_source_folders(paths, root).collect()} == {"", "/src", "/src/main/java", "/app/src", "/app/src/main/java", "/kit/src"}


def test_empty_folder(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.txt").write_text(json.dumps({}))
    g = S.scan(spark, str(tmp_path / "e"))
    assert g.nodes.count() == 0 and g.edges.agg(F.count("*")).first()[0] == 0
