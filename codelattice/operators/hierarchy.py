"""Parent-child rows of unknown depth to paths, depths, roots and descendants.

Tree contraction: every round rakes all leaves and splices out an independent set of the
nodes of unary chains (those whose hash beats both neighbours'), recording what it removed.
A forest is gone after O(log n) rounds whatever its depth; a circle shrinks to a node that
is its own parent, which no round removes, and so is exposed. The records are then replayed
backwards, each removed node taking root, depth and path from the parent it had.

All joins forward are between unique keys, so a container that holds a third of all rows is
no hot spot; counting its children is combined map-side. The replay joins many removed rows
with one parent row, and adaptive skew handling splits such a partition; of the solved rows only
those go into it that may be a parent asked for. Every round's records are checkpointed, in as
few parts as their number needs, which keeps plans and task counts short and makes rounds
survive lost executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions.mask import mask_of, may_hold
from codelattice.model import norm_id
from codelattice.session import cut

_IDS = "array<string>"
ROWS = 100_000  # in one part of a round's records
KNOWN = 500_000  # solved rows above which those that no parent asks for are kept out of a replay's shuffle


def _kept(df: DataFrame, n: int) -> DataFrame:
    """``df``, of about ``n`` rows, checkpointed in as many parts as that needs."""
    return cut(df.coalesce(max(1, -(-n // ROWS))))


def containment(edges: DataFrame, edge_type: str = "defines") -> DataFrame:
    """``child, parent`` of the rows of ``edge_type`` whose ends are present and differ."""
    return (
        edges.where(F.col("type") == edge_type)
        .select(norm_id("target").alias("child"), norm_id("source").alias("parent"))
        .where("child is not null and parent is not null and child <> parent")
    )


def hierarchy(links: DataFrame, with_path: bool = False) -> DataFrame:
    """``node_id, root_id, depth`` (and ``path``, ids from the root) of each end of ``links(child, parent)``.

    Repeated links count once; of several parents of a child the least counts, and
    ``other_parents`` tells the rest. Ends on or below a circle have the circle's least id as
    root, depth -1 and a null path. Null ends and self links are ignored; no links give no rows.
    """
    links = links.where("child is not null and parent is not null and child <> parent")
    first = cut(links.groupBy(F.col("child").alias("v")).agg(F.min("parent").alias("p"), F.max("parent").alias("q")))
    size, several = first.agg(F.count("*"), F.count_if(F.col("p") < F.col("q"))).first()
    parents = first.select(F.col("p").alias("v"))
    if several:  # ends of links that do not count are ends, too
        parents = parents.unionByName(links.join(first.where("p < q").select(F.col("v").alias("child")), "child", "left_semi").select(F.col("parent").alias("v")))
    roots = parents.distinct().join(first.select("v"), "v", "left_anti")
    state = first.select("v", "p", F.lit(1).alias("w"), F.lit(None).cast("string").alias("m"), *([F.array().cast(_IDS).alias("seg")] if with_path else []))
    removed, r = [], 0
    while True:
        r += 1
        marked = _kept(_contract(state, r), size)
        n = {x["act"]: x["n"] for x in marked.groupBy("act").agg(F.count("*").alias("n")).collect()}  # at most 4 rows
        removed.append([(marked.where(f"act = '{a}'").drop("act", "c"), n[a]) for a in ("splice", "rake") if n.get(a)])
        if not n.get("keep"):
            break
        state, size = _splice(marked, with_path), n["keep"] + n.get("core", 0)
    core = marked.where("act = 'core'")
    done = [
        roots.select(F.col("v").alias("node_id"), F.col("v").alias("root_id"), F.lit(0).alias("depth"), *([F.array("v").alias("path")] if with_path else [])),
        core.select(F.col("v").alias("node_id"), F.least("v", "m").alias("root_id"), F.lit(-1).alias("depth"), *([F.lit(None).cast(_IDS).alias("path")] if with_path else [])),
    ]
    done = [cut(done[0].unionByName(done[1]).coalesce(max(1, -(-size // ROWS))))]
    solved = done[0].count()
    for steps in reversed(removed):
        fresh = []
        for rows, n in steps:  # a raked node's parent may be a node spliced in the same round, not the other way round
            known = reduce(DataFrame.unionByName, done + fresh)
            if solved > KNOWN:
                known = may_hold(known, mask_of(rows.select(F.xxhash64("p").alias("h"))), F.xxhash64("node_id"))
            solved += n
            at = rows.join(known.withColumnRenamed("node_id", "p"), "p")
            cols = [F.col("v").alias("node_id"), "root_id", F.when(F.col("depth") < 0, -1).otherwise(F.col("depth") + F.col("w")).alias("depth")]
            if with_path:
                cols.append(F.concat("path", "seg", F.array("v")).alias("path"))
            fresh.append(at.select(*cols))
        if fresh:
            fresh = reduce(DataFrame.unionByName, fresh)
            done.append(fresh if steps is removed[0] else _kept(fresh, sum(n for _, n in steps)))
    return reduce(DataFrame.unionByName, done)


def other_parents(links: DataFrame) -> DataFrame:
    """``child, parent, kept``: the distinct links that ``hierarchy`` leaves out because the child has a lesser parent, and that one."""
    links = links.where("child is not null and parent is not null and child <> parent")
    least = links.groupBy("child").agg(F.min("parent").alias("kept"), F.max("parent").alias("_most")).where("kept <> _most").select("child", "kept")
    return links.join(least, "child").where("parent <> kept").select("child", "parent", "kept").distinct()


def _contract(state: DataFrame, r: int) -> DataFrame:
    """Each link with what this round does to its child: rake, splice, core (its own parent, alone) or keep."""
    kids = state.groupBy(F.col("p").alias("v")).agg(F.count("*").alias("n"), F.min("v").alias("c"))
    h = lambda c: F.xxhash64(F.col(c), F.lit(r))
    act = (
        F.when(F.col("n").isNull(), "rake")
        .when((F.col("n") == 1) & (F.col("v") == F.col("p")), "core")
        .when((F.col("n") == 1) & (h("v") > h("p")) & (h("v") > h("c")), "splice")
        .otherwise("keep")
    )
    return state.join(kids, "v", "left").withColumn("act", act).drop("n")


def _splice(marked: DataFrame, with_path: bool) -> DataFrame:
    """The links that stay, those below a spliced node moved up to its parent."""
    up = marked.where("act = 'splice'").select(
        F.col("c").alias("v"), F.col("p").alias("_p"), F.col("w").alias("_w"), F.least("m", "v").alias("_m"),
        *([F.concat("seg", F.array("v")).alias("_seg")] if with_path else []),
    )
    cols = ["v", F.coalesce("_p", "p").alias("p"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), F.least("m", "_m").alias("m")]
    if with_path:
        cols.append(F.when(F.col("_p").isNull(), F.col("seg")).otherwise(F.concat("_seg", "seg")).alias("seg"))
    return marked.where("act in ('keep', 'core')").join(up, "v", "left").select(*cols)


def descendants(tree: DataFrame) -> DataFrame:
    """``node_id, descendant_id, steps`` for each node of a ``hierarchy(with_path=True)`` and each node below it.

    The result has the sum of all depths as its size; it is made by exploding each node's own
    path, without a join. Ends in circles have no rows.
    """
    return (
        tree.where("path is not null")
        .select(F.col("node_id").alias("descendant_id"), F.size("path").alias("_n"), F.posexplode("path").alias("_i", "node_id"))
        .where("_i < _n - 1")
        .select("node_id", "descendant_id", (F.col("_n") - 1 - F.col("_i")).alias("steps"))
    )
