"""Degrees, rankings and counts of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.model import Graph

HUB_FLOOR = 50


def is_noise(id_: str = "id", type_: str = "type") -> Column:
    """Commits, imports, and ids starting ``unresolved_``; ghosts (``unresolved::``) are no noise."""
    i = F.col(id_)
    return F.coalesce(F.col(type_) == "intent", F.lit(False)) | i.startswith("import::") | i.startswith("unresolved_")


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree`` of every end: edges in and out, counted map-side first."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def node_degrees(g: Graph) -> DataFrame:
    """``id, degree`` of the nodes that edges end at: from a stored graph's column, else counted."""
    if "degree" in g.nodes.columns:
        return g.nodes.select("id", "degree").where("degree > 0")
    return degrees(g.edges)


def in_out_degrees(g: Graph) -> DataFrame:
    """``id, indeg, outdeg`` of every node, in one aggregation."""
    if "indeg" in g.nodes.columns:
        return g.nodes.select("id", "indeg", "outdeg")
    ends = F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i")))).alias("_e")
    d = g.edges.select(ends).groupBy("_e.id").agg(F.sum("_e.i").alias("indeg"), F.sum(1 - F.col("_e.i")).alias("outdeg"))
    zero = F.lit(0).cast("long")
    return g.nodes.select("id").join(d, "id", "left").select("id", F.coalesce("indeg", zero).alias("indeg"), F.coalesce("outdeg", zero).alias("outdeg"))


def with_degree(g: Graph) -> DataFrame:
    """The nodes with ``degree``, 0 where no edge ends."""
    if "degree" in g.nodes.columns:
        return g.nodes
    return g.nodes.join(degrees(g.edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def page_of(rows: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """Rows of a page with their ``rank`` from 1; only the rows up to its end are ever sorted."""
    if page < 1 or limit < 1:
        raise ValueError("page and limit start at 1")
    first = rows.orderBy(*order).limit(page * limit)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # page * limit rows
    return ranked.where(F.col("rank") > (page - 1) * limit)


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``pos`` from 0 in that order, which has to be total: numbers within ranges plus what the ranges before them hold.

    No task sees more than its range; the sizes of the ranges are as many rows as there are partitions.
    """
    from codelattice.session import cut

    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = parts.withColumn("_i", inside).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return out.withColumn("pos", (F.col("_before") + F.col("_i") - 1).cast("int")).drop("_part", "_i", "_before")


def page_meta(total: int, page: int, limit: int) -> dict[str, int]:
    """Pagination block; an empty result has one page."""
    return {"page": page, "limit": limit, "total": total, "totalPages": max(-(-total // limit), 1)}


def by_degree() -> list[Column]:
    return [F.col("degree").desc(), F.col("ord"), F.col("id")]


def god_nodes(g: Graph, page: int = 1, limit: int = 10, exclude_ghosts: bool = False) -> DataFrame:
    """``rank, id, name, type, degree``: the most connected nodes that are not noise."""
    rows = with_degree(g).where(~is_noise())
    if exclude_ghosts:
        rows = rows.where(~F.col("id").startswith("unresolved::"))
    return page_of(rows.select("id", "name", "type", "degree", "ord"), by_degree(), page, limit).select("rank", "id", "name", "type", "degree")


def confidence_breakdown(edges: DataFrame) -> DataFrame:
    """``confidence, n, pct`` of the known values; the percent is of all edges."""
    total = F.sum("n").over(Window.partitionBy())  # a handful of rows
    counts = edges.groupBy("confidence").agg(F.count("*").alias("n")).withColumn("pct", F.col("n") * 100.0 / total)
    return counts.where(F.col("confidence").isin("EXTRACTED", "INFERRED", "AMBIGUOUS"))


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def hub_threshold(g: Graph) -> DataFrame:
    """``threshold``: nearest-rank 99th percentile of all degrees, at least 50.

    Read off the histogram of degrees, which has few rows, rather than from sorted nodes.
    """
    hist = with_degree(g).groupBy("degree").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("degree"))
    total = F.sum("n").over(Window.partitionBy())
    at = hist.select("degree", upto.alias("upto"), total.alias("total")).where(F.col("upto") > F.floor(F.col("total") * 0.99))
    return at.agg(F.greatest(F.coalesce(F.min("degree"), F.lit(0)), F.lit(HUB_FLOOR)).cast("long").alias("threshold"))


def hubs(g: Graph, top: int = 50) -> DataFrame:
    return with_degree(g).orderBy(*by_degree()).limit(top).select("id", "degree")


def knowledge_gaps(g: Graph) -> DataFrame:
    """``id, degree`` of the nodes of degree 0 or 1 that are not noise."""
    return with_degree(g).where((F.col("degree") <= 1) & ~is_noise()).select("id", "degree", "ord")


def graph_size(g: Graph) -> DataFrame:
    e = g.edges.agg(F.count("*").alias("n"))
    return g.nodes.agg(F.count("*").alias("n_nodes")).select("n_nodes", e.scalar().alias("n_edges"))


def view_model(g: Graph) -> DataFrame:
    """``id, label, size, type, degree`` for drawing: sizes by degree; labels for hubs, or for all of at most 50 nodes.

    The top 50 and the maximum are one pass and one small join each; nothing is ranked globally.
    """
    rows = with_degree(g)
    top = hubs(g, 50).select("id", F.lit(True).alias("hub"))
    most, n = rows.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most")).scalar(), rows.agg(F.count("*").alias("n")).scalar()
    rows = rows.join(F.broadcast(top), "id", "left").withColumns({"most": most, "n": n})
    label = F.when((F.col("n") <= 50) | F.col("hub"), F.coalesce("name", "id")).otherwise("")
    return rows.select("id", label.alias("label"), (10 + 30 * F.col("degree") / F.col("most")).alias("size"), "type", "degree")
