"""Breadth-first crawls, shortest paths, and the depth-first crawl.

A frontier is a DataFrame that grows by joins; visited nodes are left out by an anti-join and
every level is checkpointed. Only the depth-first crawl, whose result depends on the order of
its stack, runs in one task, which holds the nodes it may reach and has their edges in a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions.text import terms_of
from codelattice.model import Graph
from codelattice.operators import arrays as A
from codelattice.operators.lookup import resolve_id
from codelattice.operators.measure import hub_threshold, with_degree
from codelattice.session import cut, ship

FRONT = 50_000  # nodes of a level, or reached in all, that are sent to all tasks


def term_scores(g: Graph, terms: list[str]) -> DataFrame:
    """``id, score, ord`` of nodes with a positive score.

    Per term, repeated ones again: 1000 for the whole name or id, else 100 for a beginning,
    else 1 for a part, in any case; and 0.5 for a part of the file.
    """
    name, i, file = F.lower(F.coalesce("name", F.lit(""))), F.lower("id"), F.lower(F.coalesce("file", F.lit("")))
    each = [
        F.when((name == t) | (i == t), 1000.0).when(name.startswith(t) | i.startswith(t), 100.0).when(name.contains(t) | i.contains(t), 1.0).otherwise(0.0)
        + F.when(file.contains(t), 0.5).otherwise(0.0)
        for t in terms
    ]
    score = reduce(lambda a, b: a + b, each, F.lit(0.0))
    return g.nodes.select("id", score.alias("score"), "ord").where("score > 0")


def crawl_seeds(g: Graph, question: str, top: int = 3) -> DataFrame:
    """``pos, id``: the best nodes for the terms of a question, else the node it means as a symbol."""
    terms = terms_of(question)
    rows = term_scores(g, terms).orderBy(F.desc("score"), "ord", "id").limit(top).select("id").collect() if terms else []  # ``top`` rows
    ids = [r["id"] for r in rows] or [resolve_id(g, question)]
    return g.nodes.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")


def both_ways(edges: DataFrame) -> DataFrame:
    """``u, v, ord`` of each edge from both ends; ``back`` marks the way against its direction."""
    a = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "ord", F.lit(0).alias("back"))
    return a.unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), "ord", F.lit(1).alias("back")))


def _small(df: DataFrame, n: int) -> DataFrame:
    """``df``, of ``n`` rows, to be sent to all tasks if that is few."""
    return F.broadcast(df) if n <= FRONT else df


def _near(g: Graph) -> DataFrame:
    """The edges both ways; of a graph that is not stored they are written once, since each level reads them."""
    near = both_ways(g.edges)
    return near if "degree" in g.nodes.columns else cut(near)


def bfs_levels(g: Graph, seeds: DataFrame, depth: int = 3, hubs: bool = True) -> DataFrame:
    """``id, depth, expanded``: nodes within ``depth`` steps of ``seeds(id)``, either way along edges.

    Nodes at or above the hub threshold are reached but not gone through, seeds apart.
    """
    near = _near(g).select("u", "v")
    if hubs:
        t = hub_threshold(g)
        open_ = with_degree(g).select("id", "degree").join(F.broadcast(t), F.col("degree") < F.col("threshold")).select("id")  # one row
    levels = [cut(seeds.select("id").distinct().withColumns({"depth": F.lit(0), "expanded": F.lit(depth > 0)}))]
    reached = 0
    for d in range(1, depth + 1):
        front = levels[-1].where("expanded").select(F.col("id").alias("u"))
        n, k = levels[-1].agg(F.count("*"), F.count_if("expanded")).first()
        reached += n
        seen = reduce(DataFrame.unionByName, levels).select("id")
        new = near.join(_small(front, k), "u").select(F.col("v").alias("id")).distinct().join(_small(seen, reached), "id", "left_anti")
        if d == depth:
            new = new.withColumn("expanded", F.lit(False))
        elif hubs:
            new = new.join(open_.withColumn("_o", F.lit(True)), "id", "left").select("id", F.coalesce("_o", F.lit(False)).alias("expanded"))
        else:
            new = new.withColumn("expanded", F.lit(True))
        levels.append(cut(new.select("id", F.lit(d).alias("depth"), "expanded")))
    return reduce(DataFrame.unionByName, levels)


def crawl_edges(g: Graph, levels: DataFrame) -> DataFrame:
    """``src, dst, relation, confidence`` of the edges a crawl saw: those of expanded nodes, each once, as directed.

    An expanded node sees an edge against its direction only where there is none along it.
    """
    mark = levels.select("id", "expanded")
    e = g.edges.join(mark.select(F.col("id").alias("src"), F.col("expanded").alias("se")), "src").join(mark.select(F.col("id").alias("dst"), F.col("expanded").alias("de")), "dst")
    e = e.where("se or de")
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("_r"))
    return e.join(back, ["src", "dst"], "left").where("se or _r is null").select("src", "dst", "relation", "confidence")


def shortest_path(g: Graph, source: str, target: str, most: int | None = None) -> list[tuple[str, str, str | None, bool]] | None:
    """Hops of a shortest undirected path as ``(from, to, relation, forward)``; None without a path.

    Unbounded unless ``most`` levels are given. Of several parents the one with the first edge
    is taken. The path is read back with one point lookup per hop.
    """
    if source == target:
        raise ValueError("source and target are the same node")
    spark = g.nodes.sparkSession
    near = _near(g)
    levels = [spark.createDataFrame([(source, None)], "id string, parent string")]
    n = reached = 1
    while True:
        if most is not None and len(levels) > most:
            return None
        seen = reduce(DataFrame.unionByName, levels).select("id")
        new = near.join(_small(levels[-1].select(F.col("id").alias("u")), n), "u").groupBy(F.col("v").alias("id")).agg(F.min(F.struct("ord", "back", "u")).alias("_p"))
        new = cut(new.join(_small(seen, reached), "id", "left_anti").select("id", F.col("_p.u").alias("parent")))
        levels.append(new)
        n, found = new.agg(F.count("*"), F.max(F.col("id") == target)).first()
        reached += n
        if found:
            break
        if not n:
            return None
    hops, at = [], target
    for level in reversed(levels[1:]):
        r = level.where(F.col("id") == at).first()
        fwd = g.edges.where((F.col("src") == r["parent"]) & (F.col("dst") == at)).select("relation").first()
        bwd = None if fwd else g.edges.where((F.col("src") == at) & (F.col("dst") == r["parent"])).select("relation").first()
        hops.append((r["parent"], at, (fwd or bwd)["relation"], fwd is not None))
        at = r["parent"]
    return hops[::-1]


def dfs_levels(g: Graph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """``id, depth`` of the depth-first crawl from ``seeds(pos, id)``.

    It never leaves the breadth-first crawl of the same depth, whose edges are what the one task
    gets, in order and as pairs of keys; there they wait in a file, four bytes each.
    """
    levels = bfs_levels(g, seeds, depth)
    seed = A.keyed(g.nodes.select("id").unionByName(seeds.select("id")).distinct())
    keys = cut(levels.select(A.key_of("id", seed).alias("key"), "id", "expanded"))
    inside = both_ways(g.edges).select(A.key_of("u", seed).alias("a"), A.key_of("v", seed).alias("b"), (1 - F.col("back")).alias("along"), "ord")
    inside = inside.join(_small(keys.where("expanded").select(F.col("key").alias("a")), keys.count()), "a").repartition("a")
    order = F.min(F.struct("along", "ord")).alias("_o")
    inside = cut(inside.groupBy("a", "b").agg(order).sortWithinPartitions("a", "_o", "b").select(F.lit(1).alias("kind"), "a", "b"))
    rows = keys.select(F.lit(0).alias("kind"), F.col("key").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(inside)
    start = [r["key"] for r in seeds.select("pos", A.key_of("id", seed).alias("key")).orderBy("pos").collect()]  # the seeds
    ship(g.nodes.sparkSession)
    met = rows.coalesce(1).mapInArrow(lambda batches: A.crawl_in_order(batches, start, depth), "key long, depth int")
    return keys.select("key", "id").join(met, "key").select("id", "depth")
