"""Named tools, resources and commands over a graph, with text or JSON results and errors as results."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice import scan as S
from codelattice.api import Session
from codelattice.operators import community as C
from codelattice.operators import lookup as L
from codelattice.operators import measure as M

# Where pages begin and how long they are, how far paths and crawls go.
DEFAULTS = {"page": 1, "limit": 20, "god_limit": 10, "max_hops": 8, "depth": 3, "token_budget": 2000, "mode": "bfs"}


@dataclass(frozen=True)
class Result:
    """What a tool gives: a text, and whether it tells of an error."""

    text: str
    is_error: bool = False


def _json(x) -> str:
    return json.dumps(x, indent=2, ensure_ascii=False, default=str)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]  # one page


def _page_note(total: int, page: int, limit: int, what: str) -> list[str]:
    pages = M.page_meta(total, page, limit)["totalPages"]
    return [f"\n[Page {page} of {pages} | Total: {total} {what}]"] if pages > 1 else []


def search_graph(s: Session, term: str, type: str | None = None, page: int = 1, limit: int = 20) -> str:  # noqa: A002
    g, t = s.graph, term.lower()
    hits = g.nodes.where(F.lower("id").contains(t) | F.coalesce(F.lower("name").contains(t), F.lit(False)))
    total = (hits if type is None else hits.where(F.col("type") == type)).count()
    return _json({"data": _rows(s.search(term, type, page, limit).drop("rank")), "meta": M.page_meta(total, page, limit)})


def get_node(s: Session, symbol: str, type: str | None = None, source: str | None = None) -> str:  # noqa: A002
    L.resolve_id(s.graph, symbol, type, source)
    return _json(_rows(s.node(symbol, type, source))[0])


def get_neighbors(s: Session, symbol: str, type: str | None = None, source: str | None = None, page: int = 1, limit: int = 20) -> str:  # noqa: A002
    """The node that is meant and a page of its neighbours each way; the larger side decides how many pages there are."""
    g = s.graph
    node = L.resolve_id(g, symbol, type, source)
    at = {r["id"]: r for r in _rows(g.nodes.where(F.col("id") == node).select("id", "name", "type", "file", F.col("start_line").alias("line")))}[node]
    out, totals = {"target": at}, {}
    for side, here, there in (("incoming", "dst", "src"), ("outgoing", "src", "dst")):
        totals[side] = g.edges.where((F.col(here) == node) & (F.col(there) != node)).select(there, "relation").distinct().count()
        out[side] = _rows(L.neighbors(g, node, side.removesuffix("coming").removesuffix("going"), None, page, limit).drop("rank"))
    pages = max(-(-max(totals.values()) // limit), 1)
    return _json({**out, "meta": {"page": page, "limit": limit, "totalIncoming": totals["incoming"], "totalOutgoing": totals["outgoing"], "totalPages": pages}})


def shortest_path(s: Session, source: str, target: str, max_hops: int = 8) -> str:
    return s.path(source, target, max_hops)


def god_nodes(s: Session, page: int = 1, limit: int = 10) -> str:
    total = s.graph.nodes.where(~M.is_noise()).count()
    lines = [f"  {r['rank']}. {r['name']} [id: {r['id']}] - {r['degree']} edges" for r in s.god_nodes(page, limit).orderBy("rank").collect()]
    return "\n".join(["God nodes (most connected):", *lines, *_page_note(total, page, limit, "nodes")])


def get_community(s: Session, community_id, page: int = 1, limit: int = 20) -> str:
    total = s.communities.where(F.col("community") == community_id).count()
    if not total:
        raise LookupError(f"Community {community_id} not found.")
    rows = s.community(community_id, page, limit).join(s.graph.nodes.select("id", "type"), "id").orderBy("rank").collect()
    lines = [f"  {r['name'] or r['id']} (type: {r['type']}) [id: {r['id']}]" for r in rows]
    return "\n".join([f"Community {community_id} ({total} nodes):", *lines, *_page_note(total, page, limit, "nodes")])


def get_surprises(s: Session, page: int = 1, limit: int = 20) -> str:
    total = C.surprises(s.graph, s.communities).count()
    if not total:
        return "No surprising connections found."
    rows = s.surprises(page, limit).orderBy("rank").collect()
    names = {r["id"]: r["name"] or r["id"] for r in s.graph.nodes.where(F.col("id").isin([x for r in rows for x in (r["src"], r["dst"])])).select("id", "name").collect()}
    lines = [f"  {names[r['src']]} <-> {names[r['dst']]} [{r['relation']}] - {r['why']}" for r in rows]
    return "\n".join(["Surprising cross-community connections:", *lines, *_page_note(total, page, limit, "connections")])


def query_graph(s: Session, question: str, mode: str = "bfs", depth: int = 3, token_budget: int = 2000) -> str:
    return s.query(question, mode, depth, token_budget)


def graph_stats(s: Session) -> str:
    return s.stats()


def scan_graph(s: Session, root: str, store: str | None = None, force: bool = False) -> str:
    """Scan ``root`` again and take the new graph in place of the present one."""
    spark, store = s.graph.nodes.sparkSession, store or f"{root}/{S.STORE}"
    S.scan(spark, root, store, force=force)
    s.reload(f"{store}/graph")
    size = M.graph_size(s.graph).first()
    return f"Scanned {root}: {size['n_nodes']} nodes, {size['n_edges']} edges"


TOOLS: dict[str, Callable[..., str]] = {
    f.__name__: f for f in (search_graph, get_node, get_neighbors, shortest_path, god_nodes, get_community, get_surprises, query_graph, graph_stats, scan_graph)
}
RESOURCES: dict[str, Callable[[Session], str]] = {
    "report": lambda s: s.report(), "stats": graph_stats, "god-nodes": lambda s: god_nodes(s, 1, 10), "surprises": lambda s: get_surprises(s, 1, 10),
}


def call(s: Session, tool: str, **arguments) -> Result:
    """The result of a tool; unknown tools, wrong arguments and failures are results, too, and never raise."""
    try:
        if tool not in TOOLS:
            raise LookupError(f"Unknown tool: {tool}")
        return Result(TOOLS[tool](s, **arguments))
    except Exception as e:  # noqa: BLE001
        return Result(json.dumps({"error": str(e)}), True)


def read(s: Session, resource: str) -> str:
    """The text of a resource: report, stats, god-nodes or surprises."""
    if resource not in RESOURCES:
        raise LookupError(f"Unknown resource: {resource}")
    return RESOURCES[resource](s)


# ---- command line ----------------------------------------------------------------------


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codelattice", description="Scan a folder to a graph, and read the graph.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, words: tuple[str, ...] = (), paged: int | None = None, narrowed: bool = False, **more) -> None:
        c = sub.add_parser(name)
        for w in words:
            c.add_argument(w)
        if narrowed:
            c.add_argument("-t", "--type")
            c.add_argument("-s", "--source")
        if paged:
            c.add_argument("-p", "--page", type=int, default=DEFAULTS["page"])
            c.add_argument("-l", "--limit", type=int, default=paged)
        for k, v in more.items():
            c.add_argument("--" + k.replace("_", "-"), type=type(v), default=v)

    command("scan", ("root",))
    sub.choices["scan"].add_argument("--force", action="store_true")
    command("search", ("term",), paged=DEFAULTS["limit"])
    sub.choices["search"].add_argument("-t", "--type")
    command("node", ("symbol",), narrowed=True)
    command("neighbors", ("symbol",), paged=DEFAULTS["limit"], narrowed=True)
    command("path", ("source", "target"), max_hops=DEFAULTS["max_hops"])
    command("god", paged=DEFAULTS["god_limit"])
    command("community", ("community_id",), paged=DEFAULTS["limit"])
    command("surprises", paged=DEFAULTS["limit"])
    command("query", ("question",), mode=DEFAULTS["mode"], depth=DEFAULTS["depth"], token_budget=DEFAULTS["token_budget"])
    command("stats")
    command("report")
    p.add_argument("--store", default=S.STORE, help="folder of the stored graph")
    return p


_COMMANDS = {
    "search": "search_graph", "node": "get_node", "neighbors": "get_neighbors", "path": "shortest_path", "god": "god_nodes", "community": "get_community",
    "surprises": "get_surprises", "query": "query_graph", "stats": "graph_stats",
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; the text goes to the standard output, an error to the other one with exit code 1."""
    args = vars(parser().parse_args(argv))
    name, store = args.pop("command"), args.pop("store")
    spark = spark or SparkSession.builder.appName("codelattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if name == "scan":
        try:
            size = M.graph_size(S.scan(spark, args["root"], store, force=args["force"])).first()
        except Exception as e:  # noqa: BLE001
            print(f"Scan failed: {e}", file=sys.stderr)
            return 1
        print(f"Nodes: {size['n_nodes']}\nEdges: {size['n_edges']}")
        return 0
    try:
        session = Session.load(spark, f"{store}/graph")
    except Exception:  # noqa: BLE001
        print(f"No graph in {store}; scan first", file=sys.stderr)
        return 1
    result = Result(session.report()) if name == "report" else call(session, _COMMANDS[name], **args)
    print(result.text, file=sys.stderr if result.is_error else sys.stdout)
    return int(result.is_error)
