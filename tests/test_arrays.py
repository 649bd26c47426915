"""The methods on arrays against the same by dictionaries and by DataFrames."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelattice.model import Graph
from codelattice.operators import arrays as A
from codelattice.operators import community as C
from codelattice.operators import traverse as T


def graph(spark, ids, pairs):
    nodes = spark.createDataFrame([(i, k, "class", i) for k, i in enumerate(ids)], "id string, ord long, type string, name string").coalesce(2)
    return Graph(nodes, spark.createDataFrame([(a, b, "calls", "X", k) for k, (a, b) in enumerate(pairs)], "src string, dst string, relation string, confidence string, ord long").coalesce(2))


def some_graph(seed, n, e):
    r = random.Random(seed)
    ids = sorted({f"/ws/é{r.randrange(10**6)}" for _ in range(n)} | {"lone"})
    pairs = sorted({(r.choice(ids[1:]), r.choice(ids[1 : max(2, len(ids) // 3)])) for _ in range(e)})
    pairs = [(a, b) for a, b in pairs if a != b and "lone" not in (a, b)]
    r.shuffle(pairs)
    return ids, pairs


def moves(n, links):
    """The sequential method by dictionaries."""
    seed, weights = 123456789, {}
    for a, b in links:
        weights[a, b] = weights.get((a, b), 0.0) + 1.0
    m, size, member = float(len(links)), n, list(range(n))
    while m:
        near, out, into = [{} for _ in range(size)], [0.0] * size, [0.0] * size
        for (a, b), w in weights.items():
            out[a] += w
            into[b] += w
            if a != b:
                near[a][b] = near[a].get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        com, co, ci = list(range(size)), out[:], into[:]
        seed = (seed * 9301 + 49297) % 233280
        start = int(seed / 233280 * size)
        queue, waiting, moved = [(start + k) % size for k in range(size)], [True] * size, False
        while queue:
            v = queue.pop(0)
            waiting[v] = False
            own, shared = com[v], {com[v]: 0.0}
            for u, w in near[v].items():
                shared[com[u]] = shared.get(com[u], 0.0) + w
            co[own] -= out[v]
            ci[own] -= into[v]
            gains = {c: x - (out[v] * ci[c] + into[v] * co[c]) / m for c, x in shared.items()}
            best = own
            for c, x in gains.items():
                if x > gains[best] + 1e-12:
                    best = c
            co[best] += out[v]
            ci[best] += into[v]
            if best != own:
                com[v], moved = best, True
                for u in near[v]:
                    if com[u] != best and not waiting[u]:
                        waiting[u] = True
                        queue.append(u)
        if not moved:
            break
        names = {c: k for k, c in enumerate(dict.fromkeys(com))}
        inner = [names[c] for c in com]
        member, merged = [inner[c] for c in member], {}
        for (a, b), w in weights.items():
            merged[inner[a], inner[b]] = merged.get((inner[a], inner[b]), 0.0) + w
        weights, size = merged, len(names)
    names = {c: k for k, c in enumerate(dict.fromkeys(member))}
    return [names[c] for c in member]


def depths(seeds, near, depth):
    """The depth-first crawl by dictionaries."""
    seen, stack = {s: 0 for s in seeds}, [(s, 0) for s in reversed(seeds)]
    while stack:
        at, d = stack.pop()
        for n in near.get(at, ()) if d < depth else ():
            if n not in seen:
                seen[n] = d + 1
                stack.append((n, d + 1))
    return seen


@pytest.mark.parametrize("dense", [4, 256])
def test_sequence_as_by_dictionaries(monkeypatch, dense):
    monkeypatch.setattr(A, "DENSE", dense)
    r = random.Random(dense)
    for _ in range(80):
        n = r.randint(1, 60)
        links = [(r.randrange(n) if r.random() < 0.7 else 0, r.randrange(max(1, n // r.choice([1, 3, 8])))) for _ in range(r.randint(0, 200))]
        assert C.sequential_moves(n, links) == moves(n, links)


def test_sequence_over_former_bound(spark, monkeypatch):
    monkeypatch.setattr(C, "SEQUENTIAL_EDGES", 10, raising=False)  # what it refused once, at 2,000,000
    ids, pairs = some_graph(3, 70, 160)
    g = graph(spark, ids, pairs)
    order = [(r["src"], r["dst"]) for r in C.input_order(g)[1].orderBy("pos").collect()]
    at = {x: k for k, x in enumerate(ids)}
    want = dict(zip(ids, moves(len(ids), [(at[a], at[b]) for a, b in order])))
    assert {r["id"]: r["community"] for r in C.louvain_sequential(g).collect()} == want


def test_crawl_over_former_bound(spark, monkeypatch):
    monkeypatch.setattr(T, "DFS_EDGES", 10, raising=False)  # what it refused once, at 2,000,000
    ids, pairs = some_graph(4, 90, 200)
    g = graph(spark, ids, pairs)
    near = {}
    for way in (1, 0):  # against the direction first
        for a, b in pairs:
            u, v = ((b, a), (a, b))[1 - way]
            near.setdefault(u, {}).setdefault(v, None)
    near = {u: list(x) for u, x in near.items()}
    start = [pairs[0][0], ids[-1]]
    seeds = spark.createDataFrame(list(enumerate(start)), "pos int, id string")
    for depth in (0, 1, 2, 4):
        assert {r["id"]: r["depth"] for r in T.dfs_levels(g, seeds, depth).collect()} == depths(start, near, depth)


def test_neighbours_over_several_batches():
    import pyarrow as pa

    rows = [(0, k, 0) for k in (5, -7, 9, 11)] + [(1, 5, x) for x in (9, -7, 11)]
    cut = [rows[4:6], rows[:4], rows[6:]]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*x), (pa.int32(), pa.int64(), pa.int64()))], ["kind", "a", "b"]) for x in cut]
    (got,) = A.crawl_in_order(batches, [5], 1)
    assert dict(zip(got["key"].to_pylist(), got["depth"].to_pylist())) == {5: 0, 9: 1, -7: 1, 11: 1}


def test_rounds_on_arrays_as_dataframes(spark, monkeypatch):
    ids, pairs = some_graph(5, 60, 150)
    g = graph(spark, ids, pairs)
    here = {r["id"]: r["community"] for r in C.louvain(g).collect()}
    monkeypatch.setattr(A, "CHUNK", 16)
    n, at = len(ids), {x: k for k, x in enumerate(ids)}
    h = np.array([r["h"] for r in g.nodes.select("id", F.xxhash64("id").alias("h")).orderBy("id").collect()], np.int64)
    s, d = (np.array([at[p[k]] for p in pairs], np.int32) for k in (0, 1))
    com = A.rounds(n, s, d, np.ones(len(s), np.int32), len(s), h, -1.0, C.RISE, C.LOOK)
    assert here == {x: ids[com[k]] for x, k in at.items()} and len(set(here.values())) > 2
    for bound in (0, 40):  # all levels as DataFrames, or the first only
        monkeypatch.setattr(C, "ROUNDS_EDGES", bound)
        assert {r["id"]: r["community"] for r in C.louvain(g).collect()} == here


def test_small_levels_take_few_jobs(spark):
    ids, pairs = some_graph(6, 60, 150)
    g = graph(spark, ids, pairs)
    for name, f in (("partition", C.louvain), ("sizes", lambda x: C.communities_by_size(C.louvain(x), x))):
        spark.sparkContext.setJobGroup(name, name)
        assert f(g).count()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
        assert len(jobs) < 80, (name, len(jobs))  # a round of DataFrames takes several
    spark.sparkContext.setJobGroup("rest", "rest")


def test_hash_goes_on_from_a_hash(spark):
    rows = spark.range(50).select(F.concat(F.lit("é"), "id").alias("s")).select(F.xxhash64("s").alias("h"), *[F.xxhash64("s", F.lit(k)).alias(f"k{k}") for k in (0, 1, 13)]).toPandas()
    for k in (0, 1, 13):
        assert (A.hashed_on(rows["h"].to_numpy(), k) == rows[f"k{k}"].to_numpy()).all()
