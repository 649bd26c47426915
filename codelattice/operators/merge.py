"""Merging delivered fragments: first edge per pair, last node row per id, ghosts to definitions.

Every merge is one aggregation with a map-side combine, not a sort of all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions.text import extension_of, folder_of, last_name

DEFINITIONS = ("function", "class", "type", "interface", "enum", "struct", "trait", "macro")
GHOST = "unresolved::"


def merge_edges(edges: DataFrame) -> DataFrame:
    """The first row by ``ord`` of each ordered pair ``(src, dst)``, whatever its relation; no self-loops, no null ends."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "ord")]
    first = F.min(F.struct("ord", *rest)).alias("_e")
    rows = edges.where("src is not null and dst is not null and src <> dst")
    return rows.groupBy("src", "dst").agg(first).select("src", "dst", *[f"_e.{c}" for c in rest], "_e.ord")


def merge_nodes(rows: DataFrame, mode: str = "reference") -> DataFrame:
    """One row per id: the last row that is not of type file, else the first; ``ord`` is that of the first row.

    ``mode`` "prefer_definition" lets no placeholder or external row overwrite a definition.
    A row of lower ``rank`` (1 if the column is missing) never overwrites one of higher.
    """
    if mode not in ("reference", "prefer_definition"):
        raise ValueError(f"unknown mode: {mode}")
    if "rank" not in rows.columns:
        rows = rows.withColumn("rank", F.lit(1))
    solid = F.coalesce(F.col("type") != "file", F.lit(False))
    real = ~F.coalesce(F.col("placeholder"), F.lit(False)) & ~F.coalesce(F.col("external"), F.lit(False)) if mode == "prefer_definition" else F.lit(True)
    rest = [c for c in rows.columns if c not in ("id", "ord", "rank")]
    row = F.struct(F.col("rank").alias("_rank"), *rest)
    last = F.max_by(row, F.when(solid, F.struct("rank", real.alias("real"), "ord"))).alias("_last")  # rows without an order are passed over
    first = F.min_by(row, F.struct((-F.col("rank")).alias("rank"), F.col("ord"))).alias("_first")
    out = rows.groupBy("id").agg(last, first, F.min("ord").alias("ord"))
    use = F.when(F.col("_last").isNull() | (F.col("_last._rank") < F.col("_first._rank")), F.col("_first")).otherwise(F.col("_last"))
    return out.select("id", "ord", use.alias("_n")).select("id", "ord", *[f"_n.{c}" for c in rest])


def keep_sound_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def complete_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Placeholder nodes for the ends of ``edges`` that ``nodes`` lacks.

    ``id, type, name, file, start_line, placeholder``: a function named by what follows the
    first ``::`` in the file before it.
    """
    ends = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    cut = F.instr("id", "::")
    return ends.join(nodes.select("id"), "id", "left_anti").select(
        "id", F.lit("function").alias("type"), F.when(cut > 0, F.expr("substring(id, instr(id, '::') + 2)")).otherwise(F.col("id")).alias("name"),
        F.substring_index("id", "::", 1).alias("file"), F.lit(0).alias("start_line"), F.lit(True).alias("placeholder"),
    )


def ghost_winners(nodes: DataFrame) -> DataFrame:
    """``ghost, winner, score``: the definition each ghost stands for.

    Candidates have the ghost's last name segment as name; +10 for the same folder, +5 for the
    same file extension; the first in order wins a tie. Per ghost the best is a map-side
    combined maximum, so a name with very many definitions is no hot spot; ghosts are first
    reduced to distinct (name, folder, extension).
    """
    ghosts = nodes.where(F.col("id").startswith(GHOST)).select(
        F.col("id").alias("ghost"), last_name(F.col("name")).alias("name"), folder_of(F.col("file")).alias("gd"), extension_of(F.col("file")).alias("gx")
    )
    asked = ghosts.where("name is not null").select("name", "gd", "gx").distinct()
    defs = nodes.where(~F.col("id").startswith(GHOST) & F.col("type").isin(*DEFINITIONS) & F.col("name").isNotNull()).select("id", "ord", "name", "file")
    # Of the definitions of a name only the first per folder and extension can win.
    defs = defs.select("name", folder_of(F.col("file")).alias("d"), extension_of(F.col("file")).alias("x"), "ord", "id")
    defs = defs.groupBy("name", "d", "x").agg(F.min(F.struct("ord", "id")).alias("_c"))
    score = F.when(F.col("d") == F.col("gd"), 10).otherwise(0) + F.when(F.col("x") == F.col("gx"), 5).otherwise(0)
    best = F.min(F.struct((-score).alias("worse"), F.col("_c.ord"), F.col("_c.id").alias("winner"))).alias("_b")
    won = asked.join(defs, "name").groupBy("name", "gd", "gx").agg(best)
    same = [ghosts["name"] == won["name"], ghosts["gd"].eqNullSafe(won["gd"]), ghosts["gx"].eqNullSafe(won["gx"])]
    return ghosts.join(won, same[0] & same[1] & same[2]).select("ghost", "_b.winner", (-F.col("_b.worse")).alias("score"))


def resolve_ghosts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with won ghosts gone: edges into a ghost go to its winner unless that pair exists.

    Edges out of a won ghost vanish with it; self-loops are not made; ghosts without a candidate
    stay. Of several edges that come to one pair the first counts, existing ones before rewired.
    """
    w = ghost_winners(nodes).select("ghost", "winner")
    out = edges.join(w.select(F.col("ghost").alias("src")), "src", "left_anti")
    moved = out.join(w.withColumnRenamed("ghost", "dst"), "dst", "left")
    target = F.coalesce("winner", "dst")
    rest = [c for c in edges.columns if c not in ("src", "dst", "ord")]
    moved = moved.select("src", target.alias("dst"), F.col("winner").isNotNull().alias("_m"), "ord", *rest).where("src <> dst")
    first = F.min(F.struct("_m", "ord", *rest)).alias("_e")
    kept = moved.groupBy("src", "dst").agg(first).select("src", "dst", *[f"_e.{c}" for c in rest], "_e.ord")
    return nodes.join(w.select(F.col("ghost").alias("id")), "id", "left_anti"), kept
