"""Fuzzy search, symbol resolution, node lookup and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.model import Graph
from codelattice.operators.measure import by_degree, in_out_degrees, node_degrees, page_of, with_degree

TIERS = ("exact", "suffix", "suffix, any case", "part", "part, any case")


def search(g: Graph, term: str, type_: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """``rank, id, name, type, file, links``: nodes whose id or name contains the term in any case, by degree."""
    t = term.lower()
    rows = g.nodes.where(F.lower("id").contains(t) | F.coalesce(F.lower("name").contains(t), F.lit(False)))
    if type_ is not None:
        rows = rows.where(F.col("type") == type_)
    rows = with_degree(Graph(rows, g.edges)).select("id", "name", "type", "file", "degree", "ord")
    return page_of(rows, by_degree(), page, limit).select("rank", "id", "name", "type", "file", F.col("degree").alias("links"))


def _ends(c: Column, s: str) -> Column:
    return (c == s) | c.endswith("/" + s) | c.endswith("::" + s)


def resolve(g: Graph, symbol: str, type_: str | None = None, source: str | None = None) -> DataFrame:
    """``tier, id`` of the one node a symbol means, or no row.

    Tier 1: the id itself. 2: name, id or a trailing segment of it. 3: the same in any case.
    4: a part of id or name, and in any case only if no such part is found; of several a commit
    whose hash starts with the symbol is meant, else the node of highest degree. Ties go to the
    first node. ``source`` must end the file; case counts in tier 2 only.
    """
    norm = symbol.replace("\\", "/")
    low, src = norm.lower(), (source or "").replace("\\", "/")
    i, n, f = F.col("id"), F.coalesce(F.col("name"), F.lit("")), F.coalesce(F.col("file"), F.lit(""))
    rows = g.nodes if type_ is None else g.nodes.where(F.col("type") == type_)
    loose, strict = F.lower(f).endswith(src.lower()), f.endswith(src)
    s = symbol.lower()
    tier = (
        F.when((i == norm) & loose, 1)
        .when(((n == symbol) & (n != "") | _ends(i, norm)) & strict, 2)
        .when(((F.lower(n) == s) & (n != "") | _ends(F.lower(i), low)) & loose, 3)
        .when((i.contains(symbol) | n.contains(symbol)) & loose, 4)
        .when((F.lower(i).contains(s) | F.lower(n).contains(s)) & loose, 5)
    )
    hits = rows.select("id", "ord", tier.alias("tier")).where("tier is not null")
    best = hits.agg(F.min("tier").alias("_t"))
    hits = hits.join(F.broadcast(best), F.col("tier") == F.col("_t")).drop("_t")  # one row
    hits = hits.join(node_degrees(g), "id", "left")
    part = F.col("tier") >= 4
    commit = part & i.startswith("commit::") & F.lower(F.split(i, "::").getItem(1)).startswith(s)
    order = [F.when(commit, 0).otherwise(1), F.when(part & ~commit, -F.coalesce("degree", F.lit(0))).otherwise(0), F.col("ord"), F.col("id")]
    return hits.orderBy(*order).limit(1).select("tier", "id")


def resolve_id(g: Graph, symbol: str, type_: str | None = None, source: str | None = None) -> str:
    row = resolve(g, symbol, type_, source).first()
    if row is None:
        raise LookupError(f"no node for symbol {symbol!r}" + (f" of type {type_!r}" if type_ else "") + (f" in source {source!r}" if source else ""))
    return row["id"]


def node_lookup(g: Graph, symbol: str, type_: str | None = None, source: str | None = None) -> DataFrame:
    """``id, name, type, file, line, incoming, outgoing`` of the node a symbol means."""
    one = g.nodes.join(F.broadcast(resolve(g, symbol, type_, source).select("id")), "id")  # at most one row
    if "indeg" in g.nodes.columns:
        return one.select("id", "name", "type", "file", F.col("start_line").alias("line"), F.col("indeg").alias("incoming"), F.col("outdeg").alias("outgoing"))
    ends = g.edges.join(F.broadcast(one.select(F.col("id").alias("_i"))), (F.col("src") == F.col("_i")) | (F.col("dst") == F.col("_i")))
    both = in_out_degrees(Graph(one, ends.select("src", "dst")))
    return one.join(both, "id").select("id", "name", "type", "file", F.col("start_line").alias("line"), F.col("indeg").alias("incoming"), F.col("outdeg").alias("outgoing"))


def neighbors(g: Graph, node: str, direction: str, type_: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """``rank, id, name, type, relation, confidence`` of the nodes next to ``node`` ('in' or 'out').

    The first edge per neighbour and relation counts; commits come first, then by degree.
    Filters on ``node`` reach the scan; degrees are only counted for the neighbours.
    """
    if direction not in ("in", "out"):
        raise ValueError("direction is 'in' or 'out'")
    here, there = ("dst", "src") if direction == "in" else ("src", "dst")
    e = g.edges.where((F.col(here) == node) & (F.col(there) != node)).groupBy(F.col(there).alias("id"), "relation").agg(F.min(F.struct("ord", "confidence")).alias("_e"))
    rows = e.select("id", "relation", F.col("_e.confidence").alias("confidence"), F.col("_e.ord").alias("eord"))
    stored = ["degree"] if "degree" in g.nodes.columns else []
    rows = rows.join(g.nodes.select("id", "name", "type", *stored), "id")
    if type_ is not None:
        rows = rows.where(F.col("type") == type_)
    if not stored:
        rows = rows.join(node_degrees(g).join(rows.select("id").distinct(), "id", "left_semi"), "id", "left")
    order = [F.when(F.col("type") == "intent", 0).otherwise(1), F.col("degree").desc(), F.col("eord"), F.col("id")]
    return page_of(rows, order, page, limit).select("rank", "id", "name", "type", "relation", "confidence")
