"""The reads of a stored or built graph, as one object; results are DataFrames or a page of text."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.model import Graph
from codelattice.operators import community as C
from codelattice.operators import lookup as L
from codelattice.operators import measure as M
from codelattice.operators import traverse as T
from codelattice.session import cut
from codelattice.sources import report as R
from codelattice.sources import texts


class Session:
    """Reads over one graph. Communities are found once, when first asked for."""

    def __init__(self, graph: Graph):
        self.graph = graph

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Session:
        return cls(texts.load_graph(spark, path))

    def reload(self, path: str) -> None:
        """Take the graph stored at ``path`` in place of the present one; communities are found anew."""
        self.graph = texts.load_graph(self.graph.nodes.sparkSession, path)
        self.__dict__.pop("communities", None)

    @cached_property
    def communities(self) -> DataFrame:
        return cut(C.louvain(self.graph))

    def search(self, term: str, type_: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
        return L.search(self.graph, term, type_, page, limit)

    def node(self, symbol: str, type_: str | None = None, source: str | None = None) -> DataFrame:
        return L.node_lookup(self.graph, symbol, type_, source)

    def neighbors(self, symbol: str, direction: str = "in", type_: str | None = None, source: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
        """Neighbours of the node that ``symbol``, ``type_`` and ``source`` mean."""
        return L.neighbors(self.graph, L.resolve_id(self.graph, symbol, type_, source), direction, None, page, limit)

    def path(self, source: str, target: str, max_hops: int = 8) -> str:
        """A shortest path as text; one longer than ``max_hops`` is only counted."""
        a, b = L.resolve_id(self.graph, source), L.resolve_id(self.graph, target)
        hops = T.shortest_path(self.graph, a, b)
        if hops is None:
            raise LookupError("No path exists between the given nodes")
        if len(hops) > max_hops:
            return f"Path exceeds max_hops={max_hops} ({len(hops)} hops found)."
        ids = [a, *(h[1] for h in hops)]
        names = {r["id"]: r["name"] or r["id"] for r in self.graph.nodes.where(F.col("id").isin(ids)).select("id", "name").collect()}  # max_hops + 1 rows
        ends = F.struct("src", "dst").isin([F.struct(F.lit(x), F.lit(y)) for u, v, _, forward in hops for x, y in [(u, v) if forward else (v, u)]])
        sure = {(r["src"], r["dst"]): r["confidence"] for r in self.graph.edges.where(ends).collect()}
        text = names[a]
        for u, at, relation, forward in hops:
            c = sure.get((u, at) if forward else (at, u))
            arrow = f"{relation or ''}{f' [{c}]' if c else ''}"
            text += f" --{arrow}--> {names[at]}" if forward else f" <--{arrow}-- {names[at]}"
        return f"Shortest path ({len(hops)} hops):\n  {text}"

    def god_nodes(self, page: int = 1, limit: int = 10) -> DataFrame:
        return M.god_nodes(self.graph, page, limit)

    def community(self, name: str, page: int = 1, limit: int = 20) -> DataFrame:
        return C.community_page(self.communities, self.graph, name, page, limit)

    def surprises(self, page: int = 1, limit: int = 20) -> DataFrame:
        return C.surprises_page(self.graph, self.communities, page, limit)

    def query(self, question: str, mode: str = "bfs", depth: int = 3, budget: int = 2000) -> str:
        """A crawl as text; any mode but 'bfs' goes depth first. What is collected is at most what the budget can show."""
        g = self.graph
        seeds = T.crawl_seeds(g, question)
        levels = cut(T.bfs_levels(g, seeds, depth))
        if mode != "bfs":  # what depth first reaches at the last level shows no edges of its own
            reached = T.dfs_levels(g, seeds, depth).withColumnRenamed("depth", "_d")
            levels = cut(levels.join(reached, "id").select("id", F.col("_d").alias("depth"), (F.col("expanded") & (F.col("_d") < depth)).alias("expanded")))
        first = [r["id"] for r in seeds.orderBy("pos").collect()]
        shown = budget * 3 // 10 + len(first)  # a line has ten characters at least, so no more fit; the header counts all
        rows = M.with_degree(g).join(levels.select("id"), "id").orderBy(*M.by_degree())
        nodes = {r["id"]: r.asDict() for r in rows.limit(shown).collect()}
        for r in M.with_degree(g).where(F.col("id").isin(first)).collect():
            nodes[r["id"]] = r.asDict()
        ordered = [nodes[i] for i in first] + [n for i, n in nodes.items() if i not in first]
        names = {i: n["name"] or i for i, n in nodes.items()}
        edges = [{**r.asDict(), "src": names.get(r["src"], r["src"]), "dst": names.get(r["dst"], r["dst"])} for r in T.crawl_edges(g, levels).limit(shown).collect()]
        return R.crawl_text(ordered, edges, mode, depth, [names[i] for i in first], budget, levels.count())

    def stats(self) -> str:
        return R.stats_text(self.graph, self.communities.select("community").distinct().count())

    def report(self) -> str:
        g, p = self.graph, self.communities
        count = lambda df: df.agg(F.count("*").alias("n"))
        sur = cut(C.surprises(g, p))
        q = C.suggested_questions(count(sur), M.god_nodes(g, 1, 1).select("name"), count(M.knowledge_gaps(g)), count(p.select("community").distinct()))
        return R.report_markdown(g, p, sur, q)

    def analysis(self) -> dict[str, DataFrame]:
        """Everything that is found out about a graph: god nodes, communities by size, surprises, gaps and questions."""
        g, p = self.graph, self.communities
        count = lambda df: df.agg(F.count("*").alias("n"))
        sur, gaps = cut(C.surprises(g, p)), M.knowledge_gaps(g)
        return {
            "god_nodes": M.god_nodes(g), "communities": C.communities_by_size(p, g), "surprises": M.page_of(sur, [F.desc("score"), F.col("ord"), F.col("src")], 1, 5).drop("ord"),
            "gaps": M.page_of(gaps, [F.col("ord"), F.col("id")], 1, 10).drop("ord"),
            "questions": C.suggested_questions(count(sur), M.god_nodes(g, 1, 1).select("name"), count(gaps), count(p.select("community").distinct())),
            "size": M.graph_size(g),
        }
