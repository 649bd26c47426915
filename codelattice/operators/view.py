"""What an interactive drawing of the graph asks for: visible nodes, suggestions, neighbour lists, a legend."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.model import Graph
from codelattice.operators.measure import numbered, page_of, with_degree


def visible(nodes: DataFrame, part: DataFrame, types: list[str], communities: list) -> DataFrame:
    """``nodes`` without the hidden types and communities; nodes without a type or community stay."""
    rows = nodes.join(part, "id", "left")
    hidden = F.coalesce(F.col("type").isin(*types), F.lit(False)) if types else F.lit(False)
    if communities:
        hidden = hidden | F.coalesce(F.col("community").isin(*communities), F.lit(False))
    return rows.where(~hidden)


def suggestions(g: Graph, text: str, hidden_types: tuple[str, ...] = (), top: int = 10) -> DataFrame:
    """``rank, id, name, type, score``: nodes for what is typed so far.

    Per word: 1000 for the whole name or id, else 100 for a beginning, else 1 for a part, else 0.5
    for a part of the file; a hundredth of the degree parts equals, and the order of nodes the rest.
    """
    name, i, file = F.lower(F.coalesce("name", "id")), F.lower("id"), F.lower(F.coalesce("file", F.lit("")))

    def points(t: str) -> Column:
        return (
            F.when((name == t) | (i == t), 1000.0).when(name.startswith(t) | i.startswith(t), 100.0).when(name.contains(t) | i.contains(t), 1.0)
            .when(file.contains(t), 0.5).otherwise(0.0)
        )

    score = reduce(lambda a, b: a + b, map(points, text.lower().split()), F.lit(0.0))
    rows = g.nodes.where(~F.coalesce(F.col("type").isin(*hidden_types), F.lit(False))) if hidden_types else g.nodes
    rows = rows.withColumn("points", score).where("points > 0")  # before degrees are joined
    rows = with_degree(Graph(rows, g.edges)).withColumn("score", F.col("points") + F.col("degree") * 0.01)
    return page_of(rows, [F.desc("score"), F.col("ord"), F.col("id")], 1, top).select("rank", "id", F.coalesce("name", "id").alias("name"), "type", "score")


def neighbour_list(g: Graph, node: str, direction: str, shown: DataFrame, top: int = 5) -> DataFrame:
    """``rank, id, relation, degree``: the first edges of a node to visible neighbours, commits first, then by degree; parallel edges each count."""
    here, there = ("dst", "src") if direction == "in" else ("src", "dst")
    e = g.edges.where(F.col(here) == node).select(F.col(there).alias("id"), "relation", F.col("ord").alias("eord"))
    rows = with_degree(Graph(g.nodes.join(e.select("id").distinct(), "id", "left_semi"), g.edges)).select("id", "type", "degree").join(shown.select("id"), "id", "left_semi").join(e, "id")
    order = [F.when(F.col("type") == "intent", 0).otherwise(1), F.desc("degree"), F.col("eord")]
    return page_of(rows, order, 1, top).select("rank", "id", "relation", "degree")


def legend(part: DataFrame) -> DataFrame:
    """``pos, community, n, hue``: communities in order of their label with a colour each, a golden angle apart.

    There are as many rows as communities; their order is made from counts, not from members.
    """
    return numbered(part.groupBy("community").agg(F.count("*").alias("n")), "community").select("pos", "community", "n", ((F.col("pos") * 137.5) % 360).alias("hue"))
