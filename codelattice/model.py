"""The graph model: column helpers and the projection of stored tables to a graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm_id(c: Column | str) -> Column:
    """An id is the same with either slash; the output form uses ``/``."""
    return F.translate(F.col(c) if isinstance(c, str) else c, "\\", "/")


def current_rows(nodes: DataFrame, *cols: str) -> DataFrame:
    """The row of greatest (scanned_at, ord) of each id, as ``id`` and ``cols``.

    One map-side combined aggregation, so an id with very many rows is no hot spot. Rows
    without an id are left out; a null ``scanned_at`` ranks below any time.
    """
    keep = [c for c in cols if c != "id"]
    best = F.max(F.struct(F.col("scanned_at"), F.col("ord"), *[F.col(c) for c in keep])).alias("_r")
    return (
        nodes.where(F.col("id").isNotNull())
        .groupBy(norm_id("id").alias("id"))
        .agg(best)
        .select("id", *[F.col("_r")[c].alias(c) for c in keep])
    )


@dataclass(frozen=True)
class Graph:
    """``nodes(id, ord, type, name, file, start_line, ...)`` and ``edges(src, dst, relation, confidence, ord)``.

    One node row per id and one edge row per ordered pair; no self-loops; both ends exist.
    Orders that matter end in ``ord`` and then ``id``.
    """

    nodes: DataFrame
    edges: DataFrame


NODE_COLUMNS = ("type", "name", "file", "start_line", "end_line", "external", "unresolved", "placeholder", "deprecated", "doc", "message", "author", "commit_date", "extension", "size_bytes")
EXTERNAL_ORD = 10**12  # externals come after all scanned rows


def node_rows(nodes: DataFrame, externals: DataFrame | None = None) -> DataFrame:
    """Rows of both tables in the columns of the graph, with ``rank`` 0 for externals and 1 for scanned rows."""
    rows = nodes.where("id is not null").select(
        norm_id("id").alias("id"), "ord", F.lit(1).alias("rank"), *[norm_id(c).alias(c) if c == "file" else F.col(c) for c in NODE_COLUMNS]
    )
    if externals is None:
        return rows
    given = {"type": F.col("type"), "name": F.col("name"), "external": F.lit(True)}
    kinds = dict(rows.dtypes)
    ext = externals.where("id is not null").select(
        norm_id("id").alias("id"), F.lit(EXTERNAL_ORD).alias("ord"), F.lit(0).alias("rank"),
        *[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in NODE_COLUMNS],
    )
    return rows.unionByName(ext)


def build_graph(nodes: DataFrame, edges: DataFrame, externals: DataFrame | None = None) -> Graph:
    """Merge delivered rows to a graph: last non-file node row, first edge row per pair, ends checked.

    Null ids, ends and self-loops are left out; repeated rows merge. Empty tables give an empty graph.
    """
    from codelattice.operators.merge import keep_sound_edges, merge_edges, merge_nodes

    n = merge_nodes(node_rows(nodes, externals))
    e = edges.select(norm_id("source").alias("src"), norm_id("target").alias("dst"), F.col("type").alias("relation"), "confidence", "ord")
    return Graph(n, keep_sound_edges(merge_edges(e), n))
