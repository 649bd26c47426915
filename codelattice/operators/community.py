"""Communities: detection, cohesion, surprising bridges, questions.

The analytics take any partition ``(id, community)``. Detection is Louvain's method as
DataFrame rounds: in each, nodes move to the neighbouring community of greatest directed
modularity gain, if that beats where they are and lies before it in an order that is drawn anew
and turned about every other round, so that no two swap places, until no node
moves or modularity rises no more; then communities become nodes, and again, until nothing
moves. Ties are broken by label, so reruns agree. The sequential method, in one task,
visits nodes in the order of a seeded generator instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions.text import hundredths, in_locale_order
from codelattice.model import Graph
from codelattice.operators import arrays as A
from codelattice.operators.measure import is_noise, node_degrees, numbered
from codelattice.session import cut


RISE = 1e-3  # of modularity in LOOK rounds, below which a level ends, and of a level, below which detection ends
LOOK = 3
ROUNDS_EDGES = 10_000_000  # of a level whose rounds are done in one task


def louvain(g: Graph) -> DataFrame:
    """``id, community`` of every node; the community is named by its least id. Isolated nodes stand alone.

    Levels of up to ROUNDS_EDGES edges have their rounds on arrays in one task, larger ones as
    DataFrames, with equal results: a round over few edges costs less than the jobs that share it out.
    """
    m = k = g.edges.count()
    own = g.nodes.select("id", F.col("id").alias("community"))
    if not m:
        return own
    edges = g.edges.select("src", "dst", F.lit(1.0).alias("w"))
    if k <= ROUNDS_EDGES:
        return _rounds_in_one_task(g.nodes.select("id"), edges, m, -1.0)
    edges, reached = cut(edges), -1.0
    while True:
        if k <= ROUNDS_EDGES:
            ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
            own = _composed(own, _rounds_in_one_task(ends, edges, m, reached))
            break
        part, q = _local_moves(edges, float(m))
        if q <= reached + RISE:
            break
        reached = q
        own = _composed(own, part)
        a = part.select(F.col("id").alias("src"), F.col("community").alias("s"))
        b = part.select(F.col("id").alias("dst"), F.col("community").alias("d"))
        edges = cut(edges.join(a, "src").join(b, "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w")))
        k = edges.count()
    least = own.groupBy("community").agg(F.min("id").alias("name"))
    return own.join(least, "community").select("id", F.col("name").alias("community"))


def _composed(own: DataFrame, part: DataFrame) -> DataFrame:
    """``own`` with the communities of its communities."""
    own = own.withColumnRenamed("community", "at").join(part.withColumnRenamed("id", "at"), "at", "left")
    return cut(own.select("id", F.coalesce("community", "at").alias("community")))


def _rounds_in_one_task(labels: DataFrame, edges: DataFrame, m: int, reached: float) -> DataFrame:
    """``id, community`` of ``labels(id)`` after all further levels, named by its least label."""
    seed = A.keyed(labels)
    n = numbered(labels.select("id", A.key_of("id", seed).alias("key"), F.xxhash64("id").alias("h")), "id")
    zero, none = F.lit(0), F.lit(0).cast("long")
    rows = n.select(zero.alias("kind"), "pos", F.col("key").alias("a"), F.col("h").alias("b"), none.alias("w"))
    rows = rows.unionByName(edges.select(F.lit(1).alias("kind"), zero.alias("pos"), A.key_of("src", seed).alias("a"), A.key_of("dst", seed).alias("b"), F.col("w").cast("long").alias("w")))
    part = cut(A.in_one_task(rows, lambda batches: A.rounds_of_rows(batches, m, reached, RISE, LOOK), "pos int, community int"))
    names = n.select(F.col("pos").alias("community"), F.col("id").alias("name"))
    return cut(part.join(n.select("pos", "id"), "pos").join(names, "community").select("id", F.col("name").alias("community")))


def _local_moves(edges: DataFrame, m: float) -> tuple[DataFrame, float]:
    """The partition at which moves end, and its modularity."""
    out = edges.select(F.col("src").alias("id"), F.col("w").alias("o"), F.lit(0.0).alias("i"))
    into = edges.select(F.col("dst").alias("id"), F.lit(0.0).alias("o"), F.col("w").alias("i"))
    ends = cut(out.unionByName(into).groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")))
    small = F.broadcast if ends.count() <= FEW else lambda df: df
    part = ends.select("id", F.col("id").alias("community"))
    loops = F.col("src") != F.col("dst")
    sym = edges.where(loops).select(F.col("src").alias("id"), F.col("dst").alias("other"), "w")
    sym = sym.unionByName(edges.where(loops).select(F.col("dst").alias("id"), F.col("src").alias("other"), "w"))
    still, r, reached = 0, 0, -1.0
    while True:
        mass = ends.join(small(part), "id").groupBy("community").agg(F.sum("o").alias("co"), F.sum("i").alias("ci"))
        links = sym.join(small(part.select(F.col("id").alias("other"), "community")), "other").groupBy("id", "community").agg(F.sum("w").alias("w"))
        here = part.withColumnRenamed("community", "now").join(small(ends), "id")
        # Where a node is counts as a choice, too, even without links to it.
        options = links.unionByName(part.select("id", "community", F.lit(0.0).alias("w"))).groupBy("id", "community").agg(F.sum("w").alias("w"))
        options = options.join(small(here), "id").join(small(mass), "community")
        stay = F.col("community") == F.col("now")
        co, ci = F.col("co") - F.when(stay, F.col("o")).otherwise(0), F.col("ci") - F.when(stay, F.col("i")).otherwise(0)
        gain = F.col("w") - (F.col("o") * ci + F.col("i") * co) / F.lit(m)
        best = options.withColumn("gain", F.round(gain, 9)).groupBy("id", "now").agg(
            F.max(F.struct("gain", F.when(stay, 1).otherwise(0).alias("stay"), F.col("community"))).alias("_b")
        )
        turn = F.xxhash64("_b.community", F.lit(r // 2)) < F.xxhash64("now", F.lit(r // 2))  # nobody swaps places
        turn = turn if r % 2 == 0 else ~turn
        part = cut(best.select("id", F.when(turn, F.col("_b.community")).otherwise(F.col("now")).alias("community"), (turn & (F.col("_b.community") != F.col("now"))).alias("moved")))
        moved = part.where("moved").limit(1).count()
        part, r = part.select("id", "community"), r + 1
        still = 0 if moved else still + 1
        if still == 2 or r % LOOK == 0:
            q = _quality(edges, ends, small(part), m)
            if still == 2 or q <= reached + RISE:
                return part, q
            reached = q


def _quality(edges: DataFrame, ends: DataFrame, part: DataFrame, m: float) -> float:
    a, b = part.select(F.col("id").alias("src"), F.col("community").alias("a")), part.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    inside = edges.join(a, "src").join(b, "dst").where("a = b").agg(F.sum("w")).first()[0] or 0.0
    mass = ends.join(part, "id").groupBy("community").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return inside / m - mass.agg(F.sum(F.col("o") * F.col("i"))).first()[0] / m**2


FEW = 50_000  # nodes of a level up to which its small tables are sent to all tasks


def input_order(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes ``pos, id`` by code point and distinct edges ``pos, src, dst`` by locale order of their ends: the order detection reads them in."""
    n = numbered(g.nodes.select("id").distinct(), "id").select("pos", "id")
    order = [in_locale_order(F.col("src")), in_locale_order(F.col("dst")), F.col("src"), F.col("dst")]
    return n, numbered(g.edges.select("src", "dst").distinct(), *order).select("pos", "src", "dst")


def louvain_sequential(g: Graph) -> DataFrame:
    """``id, community`` by the sequential method, communities numbered from 0.

    One task, since each move depends on the one before; it holds arrays of keys and weights, no
    ids. Deterministic: nodes and edges in ``input_order``, visits from a seeded generator.
    """
    ids = g.nodes.select("id").distinct()
    seed = A.keyed(ids)
    n = numbered(ids.select("id", A.key_of("id", seed).alias("key"), in_locale_order(F.col("id")).alias("k")), "id")
    ranks = numbered(n.select("k").distinct(), "k").withColumnRenamed("pos", "rank")  # equal keys fall back on code points
    zero = F.lit(0)
    rows = n.join(ranks, "k").select(zero.alias("kind"), "pos", F.col("key").alias("a"), F.col("rank").cast("long").alias("b"))
    e = g.edges.select(A.key_of("src", seed).alias("a"), A.key_of("dst", seed).alias("b")).distinct()
    rows = rows.unionByName(e.select(F.lit(1).alias("kind"), zero.alias("pos"), "a", "b"))
    part = A.in_one_task(rows, A.sequence_of_rows, "pos int, community int")
    return n.select("pos", "id").join(part, "pos").select("id", "community")


def sequential_moves(n: int, links: list[tuple[int, int]]) -> list[int]:
    """Community of each of ``n`` nodes: local moves from a queue until none gains, communities become nodes, and again."""
    ends = np.array(links, np.int32).reshape(-1, 2)
    return A.sequential(n, ends[:, 0], ends[:, 1]).tolist()


def communities_by_size(part: DataFrame, g: Graph) -> DataFrame:
    """``community, n, cohesion`` of each community, the largest first; communities keep their names.

    Ends meet their communities by keys, so that edges are shuffled without their ids.
    """
    ids = g.nodes.select("id")
    seed = A.keyed(ids.unionByName(part.select("id").join(ids, "id", "left_anti")))
    by_key = Graph(ids, g.edges.select(A.key_of("src", seed).alias("src"), A.key_of("dst", seed).alias("dst")))
    sizes = cohesion(by_key, part.select(A.key_of("id", seed).alias("id"), "community"))
    return sizes.select("community", "n", "cohesion").orderBy(F.desc("n"), "community")


def modularity(g: Graph, part: DataFrame) -> float:
    """Directed modularity of a partition."""
    e = g.edges.select("src", "dst").join(part.select(F.col("id").alias("src"), F.col("community").alias("a")), "src")
    e = e.join(part.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    m, inside = e.agg(F.count("*"), F.sum((F.col("a") == F.col("b")).cast("long"))).first()
    if not m:
        return 0.0
    a, b = e.groupBy(F.col("a").alias("c")).agg(F.count("*").alias("o")), e.groupBy(F.col("b").alias("c")).agg(F.count("*").alias("i"))
    return inside / m - (a.join(b, "c").agg(F.sum(F.col("o") * F.col("i"))).first()[0] or 0) / m**2


def cohesion(g: Graph, part: DataFrame) -> DataFrame:
    """``community, n, internal, cohesion``: directed edges inside over n(n-1), two decimals; 1 for a single node."""
    sizes = part.groupBy("community").agg(F.count("*").alias("n"))
    e = g.edges.select("src", "dst").join(part.select(F.col("id").alias("src"), "community"), "src")
    e = e.join(part.select(F.col("id").alias("dst"), F.col("community").alias("_d")), "dst").where(F.col("community") == F.col("_d"))
    inside = e.groupBy("community").agg(F.count("*").alias("internal"))
    out = sizes.join(inside, "community", "left").withColumn("internal", F.coalesce("internal", F.lit(0).cast("long")))
    ratio = F.col("internal") / (F.col("n") * (F.col("n") - 1)).cast("double")
    return out.withColumn("cohesion", F.when(F.col("n") <= 1, 1.0).otherwise(hundredths(ratio)))


def community_page(part: DataFrame, g: Graph, community, page: int = 1, limit: int = 20) -> DataFrame:
    """``rank, id, name`` of the members of a community in node order."""
    from codelattice.operators.measure import page_of

    rows = part.where(F.col("community") == community).select("id").join(g.nodes.select("id", "name", "ord"), "id")
    return page_of(rows, [F.col("ord"), F.col("id")], page, limit).select("rank", "id", "name")


def surprises(g: Graph, part: DataFrame) -> DataFrame:
    """``src, dst, relation, confidence, a, b, score, why``: the most surprising edge per unordered pair of communities.

    Edges between two known, different communities, without noise and structural relations,
    score 1, +2 for references, +1 from a node of degree at most 2 to one of at least 5, +3
    ambiguous or +2 inferred. The best per pair is a map-side combined maximum; the first edge wins ties.
    """
    side = part.join(g.nodes.where(~is_noise()).select("id", "name"), "id").join(node_degrees(g), "id")
    s = side.select(F.col("id").alias("src"), F.col("community").alias("a"), F.col("name").alias("sn"), F.col("degree").alias("sd"))
    d = side.select(F.col("id").alias("dst"), F.col("community").alias("b"), F.col("name").alias("dn"), F.col("degree").alias("dd"))
    e = g.edges.where(~F.col("relation").isin("imports", "defines")).join(s, "src").join(d, "dst").where(F.col("a") != F.col("b"))
    reaches = (F.least("sd", "dd") <= 2) & (F.greatest("sd", "dd") >= 5)
    low = F.col("sd") <= 2
    conf = F.coalesce("confidence", F.lit(""))
    score = 1 + F.when(F.col("relation") == "references", 2).otherwise(0) + F.when(reaches, 1).otherwise(0) + F.when(conf == "AMBIGUOUS", 3).when(conf == "INFERRED", 2).otherwise(0)
    # The wording of reasons.
    why = F.concat_ws(
        "; ", F.format_string("bridges community %s → community %s", F.col("a").cast("string"), F.col("b").cast("string")),
        F.when(F.col("relation") == "references", "references relationship (deep AST coupling)"),
        F.when(reaches, F.format_string('peripheral node "%s" unexpectedly reaches hub "%s"', F.when(low, F.col("sn")).otherwise(F.col("dn")), F.when(low, F.col("dn")).otherwise(F.col("sn")))),
        F.when(conf == "AMBIGUOUS", "ambiguous connection — needs verification").when(conf == "INFERRED", "inferred connection — not explicitly stated in source"),
    )
    e = e.select("src", "dst", "relation", "confidence", "a", "b", score.alias("score"), why.alias("why"), "ord")
    order = F.struct((-F.col("score")).alias("s"), F.col("ord").alias("o"), F.col("src").alias("u"), F.col("dst").alias("v"))
    row = F.struct("src", "dst", "relation", "confidence", "a", "b", "score", "why", "ord")
    best = e.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min_by(row, order).alias("_r"))
    return best.select("_r.*")


def surprises_page(g: Graph, part: DataFrame, page: int = 1, limit: int = 20) -> DataFrame:
    from codelattice.operators.measure import page_of

    return page_of(surprises(g, part), [F.col("score").desc(), F.col("ord"), F.col("src")], page, limit).drop("ord")


def suggested_questions(n_surprises: DataFrame, first_god: DataFrame, n_gaps: DataFrame, n_communities: DataFrame) -> DataFrame:
    """``pos, question`` from four one-row counts (``n``) and the first ranked node's ``name`` (no row: no node)."""
    s, gaps, c = (F.coalesce(F.col(x), F.lit(0)) for x in ("s", "g", "c"))
    one = first_god.agg(F.first("name").alias("name"), F.count("*").alias("gods"))
    one = one.select("name", "gods", n_surprises.select("n").scalar().alias("s"), n_gaps.select("n").scalar().alias("g"), n_communities.select("n").scalar().alias("c"))
    # The wording of questions.
    q = F.array(
        F.when(s > 0, "Why are these distinct communities connected via Surprising Connections?"),
        F.when(F.col("gods") > 0, F.format_string("How would the system react if the core logic in '%s' was refactored?", F.col("name"))),
        F.when(gaps > 5, "There are several isolated modules; are these dead code or missing integration tests?"),
        F.when(c > 1, "Are the boundaries between these communities enforced, or is there hidden leakage?"),
    )
    return one.select(F.posexplode(F.array_compact(q)).alias("pos", "question"))
