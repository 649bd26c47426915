import json

import pytest

from codelattice import tools as T
from codelattice.api import Session


@pytest.fixture(scope="module")
def session(spark):
    from codelattice.plans.graph_queries import stored

    return Session(stored(spark, "/root/testdata/sf0.001"))


def test_tools_give_text_and_errors_as_results(session):
    found = json.loads(T.call(session, "search_graph", term="emit", limit=3).text)
    assert len(found["data"]) == 3 and found["meta"]["total"] >= 3 and found["meta"]["totalPages"] == -(-found["meta"]["total"] // 3)
    assert json.loads(T.call(session, "get_node", symbol="falconstack/core::emit").text)["id"] == "falconstack/core::emit"
    near = json.loads(T.call(session, "get_neighbors", symbol="falconstack/core::emit", limit=5).text)
    assert near["target"]["id"] == "falconstack/core::emit" and len(near["incoming"]) == 5 and near["meta"]["totalIncoming"] > 5
    assert T.call(session, "god_nodes", page=2, limit=2).text.split("\n")[1].startswith("  3. ") and "[Page 2 of" in T.call(session, "god_nodes", page=2, limit=2).text
    assert T.call(session, "graph_stats").text.startswith("Nodes: ") and not T.call(session, "get_surprises", limit=2).is_error
    for tool, args in (("get_node", {"symbol": "no such thing at all"}), ("nothing", {}), ("search_graph", {"x": 1}), ("get_community", {"community_id": "no"}), ("shortest_path", {"source": "falconstack/core::emit", "target": "falconstack/core::emit"})):
        r = T.call(session, tool, **args)
        assert r.is_error and set(json.loads(r.text)) == {"error"}


def test_resources(session):
    report = T.read(session, "report")
    assert all(f"## {x}" in report for x in ("Files", "Most connected", "Communities", "Surprises", "Gaps", "Questions", "Recent commits"))
    assert T.read(session, "god-nodes").count("\n") >= 10 and T.read(session, "stats") and T.read(session, "surprises")
    with pytest.raises(LookupError):
        T.read(session, "other")


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.ts").write_text("export function first() { second(); }\nfunction second() { }\n")
    store = ["--store", str(tmp_path / "store")]
    assert T.main([*store, "stats"], spark) == 1 and "scan first" in capsys.readouterr().err
    assert T.main([*store, "scan", str(tmp_path / "w")], spark) == 0 and capsys.readouterr().out.startswith("Nodes: 3\nEdges: 3")
    assert T.main([*store, "search", "second"], spark) == 0 and json.loads(capsys.readouterr().out)["meta"]["total"] == 1
    assert T.main([*store, "path", "first", "second"], spark) == 0 and "--calls [EXTRACTED]--> second" in capsys.readouterr().out
    assert T.main([*store, "node", "nowhere at all"], spark) == 1 and "error" in capsys.readouterr().err
    args = T.parser().parse_args(["query", "x"])
    assert (args.mode, args.depth, args.token_budget) == ("bfs", 3, 2000) and T.parser().parse_args(["god"]).limit == 10 and T.parser().parse_args(["path", "a", "b"]).max_hops == 8
    s = Session.load(spark, str(tmp_path / "store/graph"))
    (tmp_path / "w/b.ts").write_text("export function third() { }\n")
    assert "5 nodes" in T.call(s, "scan_graph", root=str(tmp_path / "w"), store=str(tmp_path / "store")).text and s.graph.nodes.count() == 5
