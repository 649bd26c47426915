"""Per-key work when a few keys hold most rows: fragment-replicate by estimated load.

The load of each key is counted with a map-side combined aggregation. Keys above half of a
task's fair share are heavy: there are at most twice as many of them as tasks, whatever the
data. Heavy keys are cut into shards of at most half a share, light keys are taken together
in hash buckets, and shards and buckets are bin-packed, largest first, to tasks. Rows go
straight to the task of their shard; a matching side is replicated only to the tasks that
hold shards of its key. Only the heavy keys and the bucket sums reach the driver, both
bounded by the number of tasks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from codelattice.model import current_rows, norm_id

BUCKETS_PER_TASK = 16


@dataclass(frozen=True)
class LoadPlan:
    """Where rows go: ``heavy`` key -> task of each shard, ``light`` bucket -> task."""

    tasks: int
    heavy: dict[str, list[int]]
    light: list[int]
    loads: list[int]  # of each task


def plan_loads(loads: DataFrame, tasks: int) -> LoadPlan:
    """Bin-pack ``loads(key string, n long)`` to ``tasks``; ``loads`` is read twice and should be materialised."""
    buckets = tasks * BUCKETS_PER_TASK
    total = loads.agg(F.sum("n")).first()[0] or 0
    share = max(1.0, total / tasks / 2)
    parts = loads.groupBy(
        F.when(F.col("n") > share, F.col("key")).alias("key"),
        F.when(F.col("n") <= share, _bucket(F.col("key"), buckets)).alias("bucket"),
    ).agg(F.sum("n").alias("n"))
    rows = parts.collect()  # at most 2 * tasks heavy keys and 16 * tasks buckets
    heavy = {r["key"]: [0] * ceil(r["n"] / share) for r in rows if r["bucket"] is None}
    items = [(r["n"] / len(heavy[r["key"]]), r["key"], i) for r in rows if r["bucket"] is None for i in range(len(heavy[r["key"]]))]
    items += [(r["n"], None, r["bucket"]) for r in rows if r["bucket"] is not None]
    light, free = [i % tasks for i in range(buckets)], [(0, t) for t in range(tasks)]
    for n, key, i in sorted(items, key=lambda x: (-x[0], x[1] or "", x[2])):
        load, t = heapq.heappop(free)
        heapq.heappush(free, (load + n, t))
        if key is None:
            light[i] = t
        else:
            heavy[key][i] = t
    return LoadPlan(tasks, heavy, light, [round(n) for n, _ in sorted(free, key=lambda x: x[1])])


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _routes(df: DataFrame, plan: LoadPlan, key: str) -> DataFrame:
    """``df`` with ``_bins``, the tasks of the row's key: all shards' of a heavy one, else one."""
    spark = df.sparkSession
    heavy = spark.createDataFrame(list(plan.heavy.items()), "_hk string, _hb array<int>")  # bounded by the plan
    light = spark.createDataFrame(list(enumerate(plan.light)), "_lk int, _lb int")
    out = df.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    out = out.join(F.broadcast(light), _bucket(F.coalesce(F.col(key), F.lit("")), len(plan.light)) == F.col("_lk"), "left")
    return out.withColumn("_bins", F.coalesce("_hb", F.array("_lb"))).drop("_hk", "_hb", "_lk", "_lb")


def fragment(df: DataFrame, plan: LoadPlan, key: str, by: Column) -> DataFrame:
    """Send each row to one task of its key, chosen by the hash of ``by``; adds ``_bin``."""
    bins = F.col("_bins")
    one = F.element_at(bins, (F.pmod(F.xxhash64(by), F.size(bins)) + 1).cast("int"))
    return _routes(df, plan, key).withColumn("_bin", one).drop("_bins").repartitionById(plan.tasks, F.col("_bin"))


def replicate(df: DataFrame, plan: LoadPlan, key: str) -> DataFrame:
    """Send each row to every task that holds a shard of its key; adds ``_bin``."""
    out = _routes(df, plan, key).withColumn("_bin", F.explode(F.array_distinct("_bins"))).drop("_bins")
    return out.repartitionById(plan.tasks, F.col("_bin"))


def balanced_join(left: DataFrame, right: DataFrame, plan: LoadPlan, key: str, by: Column, how: str = "left") -> DataFrame:
    """``left`` (fragmented) joined with ``right`` (replicated) on ``key``; neither side moves again.

    Result rows are those of the plain join, ties and repeated rows included; null keys match
    nothing. ``how`` is inner, left or left_semi (right rows are replicated, so a right or full
    join would repeat them). Columns of ``right`` that ``left`` also has are dropped.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type: {how}")
    right = right.drop(*[c for c in right.columns if c in left.columns and c != key])
    return fragment(left, plan, key, by).join(replicate(right, plan, key), ["_bin", key], how)


def heavy_shards(loads: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """``keys, _shards`` of the keys of ``loads(keys, n)`` above half of a task's fair share: at most twice as many as tasks.

    ``loads`` is read twice and should be materialised. The result is made from driver rows, bounded by the tasks.
    """
    spark = loads.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    share = max(1.0, (loads.agg(F.sum("n")).first()[0] or 0) / tasks / 2)
    rows = loads.where(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("_shards")).collect()  # at most 2 * tasks
    return spark.createDataFrame(rows, loads.select(*keys).schema.add("_shards", IntegerType()))


def sharded_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame, by: Column, how: str = "inner", when: Column | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, the keys of ``heavy_shards`` dealt over that many shards.

    A row of ``left`` goes to one shard of its key, chosen by the hash of ``by``; rows of ``right``
    are repeated for the shards of their key only. Rows are those of the plain join; null keys match
    nothing. ``how`` is inner, left, left_semi or left_anti; ``when`` is a further condition over columns of both.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    few = F.broadcast(heavy)
    shard = F.coalesce(F.pmod(F.xxhash64(by), F.col("_shards")).cast("int"), F.lit(0))
    a = left.join(few, keys, "left").withColumn("_shard", shard).drop("_shards")
    b = right.join(few, keys, "left").withColumn("_shard", F.explode(F.sequence(F.lit(0), F.coalesce("_shards", F.lit(1)) - 1))).drop("_shards")
    if when is None:
        return a.join(b, [*keys, "_shard"], how).drop("_shard")
    b = b.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "_shard"]})
    same = [F.col(k) == F.col(f"_r_{k}") for k in [*keys, "_shard"]]
    out = a.join(b, reduce(lambda x, y: x & y, same) & when, how)
    return out.drop("_shard", *[f"_r_{k}" for k in [*keys, "_shard"]])


def link_ends(edges: DataFrame) -> DataFrame:
    """``key, other, n_in, n_out``: rows of edges per target and source, pre-aggregated, and per source."""
    e = edges.select(norm_id("source").alias("s"), norm_id("target").alias("t"))
    into = e.where("t is not null").groupBy(F.col("t").alias("key"), F.col("s").alias("other")).agg(F.count("*").alias("n_in"))
    out = e.where("s is not null").groupBy(F.col("s").alias("key")).agg(F.count("*").alias("n_out"))
    return into.withColumn("n_out", F.lit(0).cast("long")).unionByName(
        out.select("key", F.lit(None).cast("string").alias("other"), F.lit(0).cast("long").alias("n_in"), "n_out")
    )


def target_report(edges: DataFrame, nodes: DataFrame, externals: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per target: ``target, name, type, n_rows, n_callers, degree``.

    ``n_rows`` rows of edges name it, from ``n_callers`` distinct non-null sources; ``degree``
    adds the rows that start from it. Name and type are those of its current node row, else of
    its external, else null. Null targets are left out; repeated rows count.
    """
    spark = edges.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    from codelattice.session import cut

    ends = cut(link_ends(edges))
    plan = plan_loads(cut(ends.groupBy("key").agg(F.count("*").alias("n"))), tasks)
    known = current_rows(nodes, "name", "type").select("id", "name", "type", F.lit(0).alias("rank"))
    known = known.unionByName(externals.select(norm_id("id").alias("id"), "name", "type", F.lit(1).alias("rank")))
    known = known.where("id is not null").groupBy(F.col("id").alias("key")).agg(F.min(F.struct("rank", "name", "type")).alias("_k"))
    known = known.select("key", F.col("_k.name").alias("name"), F.col("_k.type").alias("type"))
    rows = balanced_join(ends, known, plan, "key", F.coalesce("other", F.lit("")))
    shards = rows.groupBy("_bin", "key").agg(  # in place: a shard lies in one task; its sources lie in no other shard
        F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.count("other").alias("callers"),
        F.first("name", True).alias("name"), F.first("type", True).alias("type"),
    )
    return (
        shards.groupBy(F.col("key").alias("target"))
        .agg(
            F.first("name", True).alias("name"), F.first("type", True).alias("type"),
            F.sum("n_in").alias("n_rows"), F.sum("callers").alias("n_callers"), F.sum(F.col("n_in") + F.col("n_out")).alias("degree"),
        )
        .where("n_rows > 0")
    )


def hot_targets(edges: DataFrame, nodes: DataFrame, externals: DataFrame, share: float = 0.01) -> DataFrame:
    """The ``target_report`` of targets that at least ``share`` of all rows name, null targets counted in the total."""
    total = edges.agg(F.count("*").alias("n")).scalar()
    return target_report(edges, nodes, externals).where(F.col("n_rows") >= total * share)
