"""Small hand-made graphs with results worked out by hand."""

import random

import pytest

from codelattice.functions.text import fixed1, terms_of
from codelattice.model import Graph, build_graph, current_rows
from codelattice.operators import community as C
from codelattice.operators import history as H
from codelattice.operators import lookup as L
from codelattice.operators import measure as M
from codelattice.operators import merge as W
from codelattice.operators import traverse as T

N = "id string, ord long, type string, name string, file string, start_line int"
E = "src string, dst string, relation string, confidence string, ord long"


def graph(spark, nodes, edges):
    n = [x if len(x) == 6 else (x[0], k, *x[1:], *[None] * (5 - len(x))) for k, x in enumerate(nodes)]
    e = [(*x, *["calls", "EXTRACTED"][len(x) - 2 :], k) for k, x in enumerate(edges)]
    return Graph(spark.createDataFrame(n, N), spark.createDataFrame(e, E))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_first_edge_per_pair_and_no_loops(spark):
    e = spark.createDataFrame([("a", "b", "imports", None, 2), ("a", "b", "calls", "X", 1), ("a", "a", "calls", "X", 0), ("b", "a", "calls", "X", 3), (None, "a", "calls", "X", 4)], E)
    assert sorted(rows(W.merge_edges(e))) == [("a", "b", "calls", "X", 1), ("b", "a", "calls", "X", 3)]
    assert W.merge_edges(e.limit(0)).count() == 0


def test_last_non_file_row_wins(spark):
    s = N + ", placeholder boolean, external boolean"
    r = [
        ("f", 1, "file", "first", None, 0, None, None), ("f", 2, "file", "second", None, 0, None, None), ("d", 1, "class", "Def", "a", 5, None, None), ("d", 2, "function", "Later", "", 0, True, True),
        ("d", 3, "file", "No", None, 0, None, None), ("m", 1, "file", "m", None, 0, None, None), ("m", 2, "media", "m2", None, 0, None, None), ("t", 1, None, "T", None, 0, None, None),
    ]
    df = spark.createDataFrame(r, s)
    assert {x[0]: (x[3], x[1]) for x in rows(W.merge_nodes(df))} == {"f": ("first", 1), "d": ("Later", 1), "m": ("m2", 1), "t": ("T", 1)}
    assert {x[0]: x[3] for x in rows(W.merge_nodes(df, "prefer_definition"))}["d"] == "Def"
    with pytest.raises(ValueError):
        W.merge_nodes(df, "other")


def test_ghosts(spark):
    nodes = [
        ("unresolved::x.y.z", "function", "x.y.z", "/p/b.ts"), ("unresolved::a::b", "function", "a::b", "/q/c.go"), ("unresolved::none", "function", "none", "/p/b.ts"), ("/p/b.ts::caller", "function", "caller", "/p/b.ts"),
        ("/o/a.go::z", "function", "z", "/o/a.go"), ("/o/a.ts::z", "class", "z", "/o/a.ts"), ("/p/k.ts::z", "function", "z", "/p/k.ts"), ("/p/l.ts::z", "function", "z", "/p/l.ts"), ("/z::b", "file", "b", "/z"), ("/z/1.go::b", "macro", "b", "/z/1.go"),
    ]
    edges = [("/p/b.ts::caller", "unresolved::x.y.z"), ("/p/b.ts::caller", "unresolved::a::b"), ("/p/b.ts::caller", "/z/1.go::b", "imports"), ("unresolved::x.y.z", "/p/b.ts::caller"), ("/p/k.ts::z", "unresolved::x.y.z"), ("/p/b.ts::caller", "unresolved::none")]
    g = graph(spark, nodes, edges)
    assert {(x[0], x[1], x[2]) for x in rows(W.ghost_winners(g.nodes))} == {("unresolved::x.y.z", "/p/k.ts::z", 15), ("unresolved::a::b", "/z/1.go::b", 5)}
    n, e = W.resolve_ghosts(g.nodes, g.edges)
    assert {(x["src"], x["dst"], x["relation"]) for x in e.collect()} == {("/p/b.ts::caller", "/p/k.ts::z", "calls"), ("/p/b.ts::caller", "/z/1.go::b", "imports"), ("/p/b.ts::caller", "unresolved::none", "calls")}
    assert n.count() == 8


def test_completion(spark):
    g = graph(spark, [("a",)], [("a", "f.ts::K.m"), ("b", "b")])
    assert rows(W.complete_ends(g.edges, g.nodes)) == [("f.ts::K.m", "function", "K.m", "f.ts", 0, True)]


def test_noise_ranks_and_pages(spark):
    nodes = [("import::x", "file", "x"), ("commit::1", "intent", "c"), ("unresolved::g", "function", "g"), ("a", "class", "A"), ("b", "class", "B"), ("lone", "class", "L")]
    g = graph(spark, nodes, [("a", "unresolved::g"), ("b", "unresolved::g"), ("a", "import::x"), ("commit::1", "a"), ("b", "a")])
    assert [(r["rank"], r["id"], r["degree"]) for r in M.god_nodes(g).collect()] == [(1, "a", 4), (2, "unresolved::g", 2), (3, "b", 2), (4, "lone", 0)]
    assert [r["id"] for r in M.god_nodes(g, 2, 3).collect()] == ["lone"] and M.god_nodes(g, 9, 3).count() == 0
    assert [r["id"] for r in M.god_nodes(g, 1, 2, exclude_ghosts=True).collect()] == ["a", "b"]
    assert {r["id"] for r in M.knowledge_gaps(g).collect()} == {"lone"}
    assert M.page_meta(0, 1, 20)["totalPages"] == 1 and M.page_meta(41, 1, 20)["totalPages"] == 3
    assert sum(r["degree"] for r in M.degrees(g.edges).collect()) == 2 * g.edges.count()
    with pytest.raises(ValueError):
        M.god_nodes(g, 0)


def test_hub_threshold_is_nearest_rank(spark):
    nodes = [(f"n{k}",) for k in range(200)]
    g = graph(spark, nodes, [("n0", f"n{k}") for k in range(1, 200)] + [("n1", f"n{k}") for k in range(2, 80)])
    assert rows(M.hub_threshold(g)) == [(79,)]
    small = graph(spark, nodes[:5], [("n0", "n1")])
    assert rows(M.hub_threshold(small)) == [(50,)] and rows(M.hub_threshold(Graph(small.nodes.limit(0), small.edges.limit(0)))) == [(50,)]


def test_resolver_tiers(spark):
    nodes = [
        ("/s/Foo.ts", "file", "Foo.ts", "/s/Foo.ts"), ("/s/Foo.ts::Bar", "class", "Bar", "/s/Foo.ts"), ("/s/foo.ts::bar", "function", "bar", "/s/foo.ts"), ("commit::ab12", "intent", "Commit ab12", ""),
        ("/s/x.ts::cab1", "function", "cab1", "/s/x.ts"), ("/s/y.ts::longName", "function", "longName", "/s/y.ts"), ("/s/z.ts::longNameToo", "function", "longNameToo", "/s/z.ts"), ("/s/n.ts::none", "function", None, None),
    ]
    g = graph(spark, nodes, [("/s/z.ts::longNameToo", "/s/x.ts::cab1")])
    one = lambda *a: next(iter(rows(L.resolve(g, *a))), None)
    assert one("\\s\\Foo.ts::Bar") == (1, "/s/Foo.ts::Bar") and one("/s/Foo.ts::Bar", "function") == (3, "/s/foo.ts::bar") and one("/s/Foo.ts::Bar", "enum") is None
    assert one("Bar") == (2, "/s/Foo.ts::Bar") and one("bar") == (2, "/s/foo.ts::bar") and one("BAR") == (3, "/s/Foo.ts::Bar")
    assert one("bar", None, "Foo.ts") == (3, "/s/Foo.ts::Bar")  # the source's case counts in tier 2 only
    assert one("ab1") == (4, "commit::ab12") and one("ongName") == (4, "/s/z.ts::longNameToo") and one("ONGNAME") == (5, "/s/z.ts::longNameToo")
    assert one("zzz") is None
    with pytest.raises(LookupError):
        L.resolve_id(g, "zzz")


def test_search_takes_signs_literally(spark):
    g = graph(spark, [("a%b", "class", "X_Y"), ("ab", "class", None), ("axb", "type", "xzy")], [("ab", "axb")])
    assert [r["id"] for r in L.search(g, "%").collect()] == ["a%b"] and [r["id"] for r in L.search(g, "x_y").collect()] == ["a%b"]
    assert [r["id"] for r in L.search(g, "").collect()] == ["ab", "axb", "a%b"] and L.search(g, "a", "type").count() == 1


def test_neighbours(spark):
    nodes = [("t", "class", "T"), ("a", "class", "A"), ("b", "class", "B"), ("commit::1", "intent", "C")]
    e = [("a", "t", "calls", "X"), ("a", "t", "calls", "Y"), ("a", "t", "imports", "X"), ("b", "t", "calls", "X"), ("commit::1", "t", "explains", "X"), ("t", "b", "calls", "X")]
    g = graph(spark, nodes, e)
    assert [(r["id"], r["relation"], r["confidence"]) for r in L.neighbors(g, "t", "in").collect()] == [("commit::1", "explains", "X"), ("a", "calls", "X"), ("a", "imports", "X"), ("b", "calls", "X")]
    assert [r["id"] for r in L.neighbors(g, "t", "out").collect()] == ["b"]
    assert rows(L.node_lookup(g, "T")) == [("t", "T", "class", None, None, 5, 1)]


def test_paths(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(9)] + [("n9", "n8"), ("x", "y")]
    g = graph(spark, [(f"n{k}",) for k in range(10)] + [("x",), ("y",)], chain)
    hops = T.shortest_path(g, "n0", "n9")
    assert len(hops) == 9 and hops[0] == ("n0", "n1", "calls", True) and hops[-1][3] is True
    back = T.shortest_path(g, "n3", "n1")
    assert [h[3] for h in back] == [False, False]
    assert T.shortest_path(g, "n0", "x") is None and T.shortest_path(g, "n0", "n9", most=3) is None
    with pytest.raises(ValueError):
        T.shortest_path(g, "x", "x")


def test_crawls(spark):
    pairs = [("A", "B"), ("A", "C"), ("C", "X"), ("X", "Y"), ("B", "Y"), ("Y", "Z")]
    g = graph(spark, [(k,) for k in "ABCXYZ"], pairs)
    seeds = spark.createDataFrame([(0, "A")], "pos int, id string")
    assert {r["id"]: r["depth"] for r in T.bfs_levels(g, seeds, 3).collect()} == {"A": 0, "B": 1, "C": 1, "X": 2, "Y": 2, "Z": 3}
    assert {r["id"]: r["depth"] for r in T.dfs_levels(g, seeds, 3).collect()} == {"A": 0, "B": 1, "C": 1, "X": 2, "Y": 3}
    assert {(r["src"], r["dst"]) for r in T.crawl_edges(g, T.bfs_levels(g, seeds, 1)).collect()} == {("A", "B"), ("A", "C")}
    both = graph(spark, [("A",), ("B",)], [("A", "B", "calls", "x"), ("B", "A", "imports", "y")])
    assert rows(T.crawl_edges(both, T.bfs_levels(both, seeds, 1)))[0][2] == "calls"


def test_hubs_are_reached_but_not_crossed(spark):
    g = graph(spark, [("s",), ("hub",), ("t",)] + [(f"k{i}",) for i in range(60)], [("s", "hub"), ("hub", "t")] + [(f"k{i}", "hub") for i in range(60)])
    seeds = spark.createDataFrame([(0, "s")], "pos int, id string")
    assert {r["id"] for r in T.bfs_levels(g, seeds, 3).collect()} == {"s", "hub"}
    assert T.bfs_levels(g, seeds, 3, hubs=False).count() == 63 and T.bfs_levels(g, spark.createDataFrame([(0, "hub")], "pos int, id string"), 1).count() == 63


def test_terms(spark):
    assert terms_of("How? does IT the it, the") == ["how", "does", "the", "the"]
    g = graph(spark, [("how", "class", "x", "thefile"), ("b", "class", "the", None)], [])
    assert {r["id"]: r["score"] for r in T.term_scores(g, ["how", "the", "the"]).collect()} == {"how": 1001.0, "b": 2000.0}
    assert rows(T.crawl_seeds(g, "b"))[0] == (0, "b")


def test_louvain_splits_two_cliques(spark):
    import itertools

    a, b = [f"a{k}" for k in range(4)], [f"b{k}" for k in range(4)]
    e = list(itertools.combinations(a, 2)) + list(itertools.combinations(b, 2)) + [("a0", "b0")]
    g = graph(spark, [(x,) for x in [*a, *b, "lone"]], e)
    p = C.louvain(g)
    got = {}
    for r in p.collect():
        got.setdefault(r["community"], set()).add(r["id"])
    assert got == {"a0": set(a), "b0": set(b), "lone": {"lone"}} and C.modularity(g, p) > 0.3
    assert {r["id"]: r["community"] for r in C.louvain(g).collect()} == {r["id"]: r["community"] for r in p.collect()}
    coh = {r["community"]: (r["n"], r["internal"], r["cohesion"]) for r in C.cohesion(g, p).collect()}
    assert coh == {"a0": (4, 6, 0.5), "b0": (4, 6, 0.5), "lone": (1, 0, 1.0)}
    assert C.louvain(Graph(g.nodes, g.edges.limit(0))).where("id = community").count() == 9


def test_surprise_scores(spark):
    nodes = [("p", "class", "P"), ("hub", "class", "H"), ("q", "class", "Q"), ("r", "class", "R"), ("import::i", "file", "i")] + [(f"k{i}", "class", "K") for i in range(5)]
    e = [("p", "hub", "references", "AMBIGUOUS"), ("q", "r", "calls", "INFERRED"), ("r", "q", "references", "EXTRACTED"), ("p", "import::i", "calls", "X"), ("q", "p", "defines", "AMBIGUOUS")] + [(f"k{i}", "hub", "calls", "X") for i in range(5)]
    g = graph(spark, nodes, e)
    part = spark.createDataFrame([("p", 1), ("hub", 2), ("q", 3), ("r", 4), ("import::i", 9)], "id string, community int")
    got = {(r["src"], r["dst"]): (r["score"], r["why"]) for r in C.surprises(g, part).collect()}
    assert got[("p", "hub")][0] == 6 and got[("q", "r")][0] == 3  # of q-r and r-q, both 3, the first edge
    assert set(got) == {("p", "hub"), ("q", "r")}
    assert "reference" in got[("p", "hub")][1] and "ambiguous" in got[("p", "hub")][1]


def test_history(spark):
    n = spark.createDataFrame(
        [("/a.ts::f", "function", 2, 4, None), ("/a.ts::g", "function", 5, None, None), ("/a.ts", "file", 0, None, None), ("/x/yarn.lock", "file", 0, None, None), ("/a.ts::e", "function", 2, 4, True), ("/a.ts::z", "function", 0, None, None)],
        "id string, type string, start_line int, end_line int, external boolean",
    )
    b = spark.createDataFrame([("/a.ts", 1, "h1"), ("/a.ts", 2, "h2"), ("/a.ts", 4, "h2"), ("/a.ts", 5, "h3"), ("/a.ts", 200, "h4"), ("/a.ts", 3, "0000000000"), ("/x/yarn.lock", 1, "h1"), (None, 1, "h1")], "file string, line int, hash string")
    got = {tuple(r) for r in H.symbol_commits(n, b).collect()}
    assert got == {("/a.ts::f", "h2", 2), ("/a.ts::g", "h3", 5), ("/a.ts", "h1", 1), ("/a.ts", "h2", 2), ("/a.ts", "h3", 5), ("/a.ts", "h4", 200)}
    assert H.symbol_commits(n, b, spark.createDataFrame([("/other",)], "file string")).count() == 0
    commits = spark.createDataFrame([("h2", "m", "a", "2024"), ("h2", "m", "a", "2024"), ("h9", None, None, None)], "hash string, message string, author string, commit_date string")
    e = spark.createDataFrame([("commit::h2", "/a.ts", "explains", "X", 1)], E)
    nodes, edges = H.commit_graph(n, e, H.symbol_commits(n, b), commits)
    assert [(r["id"], r["name"]) for r in nodes.collect()] == [("commit::h2", "Commit h2")] and [(r["src"], r["dst"]) for r in edges.collect()] == [("commit::h2", "/a.ts::f")]
    assert {r["hash"] for r in H.missing_commits(b, commits).where("hash like 'h%'").collect()} == {"h1", "h3", "h4"}
    h = "a" * 40
    text = spark.createDataFrame([("/f", 0, f"{h} 1 7 1"), ("/f", 1, "author X"), ("/f", 2, f"{'b' * 40} 3 7")], "file string, pos int, value string")
    assert rows(H.parse_blame(text)) == [("/f", 7, "b" * 40)]
    show = spark.createDataFrame([(f"{h}<<field>>Ann<<field>>2024-01-01T00:00:00Z<<field>>subject\n\nbody",), ("junk",)], "value string")
    assert rows(H.parse_commits(show)) == [(h, "Ann", "2024-01-01T00:00:00Z", "subject\n\nbody")]


def test_build_graph_from_dirty_tables(spark):
    n = spark.createDataFrame([("a\\b", 2, "class", "B", "a\\b"), ("a/b", 1, "file", "b", None), (None, 3, "class", None, None)], "id string, ord long, type string, name string, file string")
    for c in ("start_line int", "end_line int", "external boolean", "unresolved boolean", "placeholder boolean", "deprecated boolean", "doc string", "message string", "author string", "commit_date string", "extension string", "size_bytes long", "relation string"):
        n = n.selectExpr("*", f"cast(null as {c.split()[1]}) as {c.split()[0]}")
    e = spark.createDataFrame([("a/b", "x", "calls", None, 1), ("a\\b", "x", "imports", None, 2), ("a/b", "gone", "calls", None, 3), ("a/b", None, "calls", None, 4)], "source string, target string, type string, confidence string, ord long")
    x = spark.createDataFrame([("x", "X", "function", None)], "id string, name string, type string, lang string")
    g = build_graph(n, e, x)
    assert {r["id"]: (r["type"], r["ord"]) for r in g.nodes.collect()} == {"a/b": ("class", 1), "x": ("function", 10**12)}
    assert rows(g.edges) == [("a/b", "x", "calls", None, 1)]
    assert build_graph(n.limit(0), e, x.limit(0)).edges.count() == 0
    from datetime import datetime as dt

    c = spark.createDataFrame([("a", 1, dt(2024, 1, 2), "new"), ("a", 9, dt(2024, 1, 1), "old"), ("a", 2, dt(2024, 1, 2), "newest"), ("b", 1, None, "only")], "id string, ord long, scanned_at timestamp, name string")
    assert dict(rows(current_rows(c, "name"))) == {"a": "newest", "b": "only"}


def test_percent_text():
    assert fixed1(0.35) == "0.3" and fixed1(0.25) == "0.3" and fixed1(100.0) == "100.0"


def test_bfs_is_monotone_on_random_graphs(spark):
    r = random.Random(2)
    e = {(f"v{r.randint(0, 40)}", f"v{r.randint(0, 40)}") for _ in range(60)}
    g = graph(spark, [(f"v{k}",) for k in range(41)], sorted(x for x in e if x[0] != x[1]))
    lev = {x["id"]: x["depth"] for x in T.bfs_levels(g, spark.createDataFrame([(0, "v0")], "pos int, id string"), 4, hubs=False).collect()}
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, front = {"v0": 0}, {"v0"}
    for d in range(1, 5):
        front = {n for x in front for n in near.get(x, ()) if n not in want}
        want |= dict.fromkeys(front, d)
    assert lev == want


def test_numbers_without_one_task(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as k", "'x' as c")
    got = M.numbered(df, "k").collect()
    assert [r["pos"] for r in sorted(got, key=lambda r: r["k"])] == list(range(1000)) and M.numbered(df.limit(0), "k").count() == 0


def test_locale_order_and_input_order(spark):
    g = graph(spark, [("b",), ("A",), ("a",), ("B",)], [("b", "a"), ("A", "a"), ("a", "B"), ("B", "A")])
    n, e = C.input_order(g)
    assert [r["id"] for r in n.orderBy("pos").collect()] == ["A", "B", "a", "b"]  # code points
    assert [r["src"] for r in e.orderBy("pos").collect()] == ["a", "A", "b", "B"]  # as in a dictionary


def test_sequential_communities(spark):
    edges = [(f"{s}{i}", f"{s}{j}") for s in "xyz" for i in range(5) for j in range(5) if i != j] + [("x0", "y0"), ("y0", "z0")]
    g = graph(spark, [(f"{s}{i}",) for s in "xyz" for i in range(5)] + [("lone",)], edges)
    for part in (C.louvain_sequential(g), C.louvain(g)):
        groups = {}
        for r in part.collect():
            groups.setdefault(r["community"], set()).add(r["id"][0])
        assert sorted("".join(sorted(v)) for v in groups.values()) == ["l", "x", "y", "z"]
    assert [tuple(r)[1] for r in C.communities_by_size(C.louvain(g), g).collect()] == [5, 5, 5, 1]
    assert C.louvain_sequential(graph(spark, [("a",)], [])).count() == 1 and C.sequential_moves(0, []) == []
    assert C.modularity(g, C.louvain(g)) >= C.modularity(g, C.louvain_sequential(g)) - 1e-9


def test_lock_files_and_text_helpers(spark):
    from codelattice.functions.text import html_escaped, without_ansi

    names = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "shrinkwrap.json", "npm-shrinkwrap.json", "Gemfile.lock", "Cargo.lock", "Pipfile.lock", "poetry.lock", "composer.lock", "packages.lock.json", "CHANGELOG.md", "CHANGELOG.txt", "go.sum", "uv.lock", "gradle.lockfile"]
    n = spark.createDataFrame([(f"/a/{x}", "file", 0, None, None) for x in [*names, "bun.lock", "main.go"]], "id string, type string, start_line int, end_line int, external boolean")
    assert {r["id"] for r in H.enrichable(n).collect()} == {"/a/bun.lock", "/a/main.go"}
    t = spark.createDataFrame([("\x1b[31mred\x1b[0m <b class=\"x\">&'",), (None,)], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in t.select(without_ansi(F.col("t"))).collect()] == ["red <b class=\"x\">&'", None]
    assert t.select(html_escaped(without_ansi(F.col("t")))).first()[0] == "red &lt;b class=&quot;x&quot;&gt;&amp;&#039;"


def test_report_members_count_external_files(spark):
    from codelattice.sources.report import file_members

    nodes = spark.createDataFrame([("f", 0, "file", "f", None, 0, None), ("x", 1, "file", "x", None, 0, True), ("g", 2, "file", "g", None, 0, None), ("m", 3, "class", "M", None, 0, None)], N + ", external boolean")
    e = spark.createDataFrame([("f", "m", "defines", "X", 0), ("g", "m", "defines", "X", 1), ("x", "m", "defines", "X", 2)], E)
    assert [r["file"] for r in file_members(Graph(nodes, e), files=2).collect()] == ["f"]
