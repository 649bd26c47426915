"""References to records that do not exist, as of the time of the reference.

Parents are versions with a life span. The references are reduced to their distinct non-null
(key, time) pairs, counted per end on the way; a left anti-join of these against the sound
life spans of the same key leaves the offending pairs. Only these are told apart further, by a
semi-join against all life spans and the first begin of their key, and joined back to the
references. The report needs no join back: the pairs bring their counts.

Skew: pairs are combined map-side, so a key with a single instant is one row; the anti-join
shards keys by their measured number of instants, the join back by their number of rows. A key
with more than VERSIONS versions is not tested against each of them: a sweep over time says at
which instants it lives, in cells of a range partitioning, so no key's whole history is in one
task, and the anti-join is on equal instants.

Keys travel as two independent 64-bit hashes, not as text: paths are long, and shuffling
them would cost several times the input. Two different ids of a billion share both hashes
with a probability below 1e-20.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.mask import mask_of, may_hold
from codelattice.model import norm_id
from codelattice.operators.skew import heavy_shards, sharded_join
from codelattice.session import cut

ENDPOINTS = ("source", "target")
VERSIONS = 256  # of a key that an instant is tested against one by one; above that its history is swept
CELL = 1_000_000  # marks of histories in one cell of a sweep
_KEY = ["k1", "k2"]
_FIRST, _LAST = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def _instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _time(c: str, default: str) -> Column:
    return F.coalesce(F.col(c).cast("timestamp_ntz"), _instant(default))


def _key(c: str) -> list[Column]:
    """Two hashes that stand for an id; null for null."""
    text = norm_id(c)
    return [F.when(text.isNotNull(), F.xxhash64(F.lit(seed), text)).alias(f"k{seed}") for seed in (1, 2)]


def parent_versions(nodes: DataFrame, externals: DataFrame) -> DataFrame:
    """``k1, k2, begun, ended, real`` of the distinct versions that an end may name.

    A version without begin begins after every reference; one that ends before it begins never lives.
    """
    n = nodes.where("id is not null").select(*_key("id"), _time("scanned_at", _LAST).alias("begun"), _time("removed_at", _LAST).alias("ended"), (~F.coalesce("unresolved", F.lit(False))).alias("real"))
    x = externals.where("id is not null").select(*_key("id"), _time("added_at", _LAST).alias("begun"), _time("withdrawn_at", _LAST).alias("ended"), F.lit(True).alias("real"))
    return n.unionByName(x).distinct()


def references(edges: DataFrame, key: str = "ord", time: str = "scanned_at") -> DataFrame:
    """``ord, endpoint, k1, k2, at``: one row per non-null end; a missing time becomes the first instant."""
    ends = F.explode(F.array(*[F.struct(F.lit(e).alias("endpoint"), *_key(e)) for e in ENDPOINTS]))
    return (
        edges.select(F.col(key).alias("ord"), _time(time, _FIRST).alias("at"), ends.alias("_e"))
        .where(F.col("_e.k1").isNotNull())
        .select("ord", F.col("_e.endpoint").alias("endpoint"), F.col("_e.k1").alias("k1"), F.col("_e.k2").alias("k2"), "at")
    )


def asked_instants(refs: DataFrame) -> DataFrame:
    """``k1, k2, at`` and the number of references per end, ``source`` and ``target``: the distinct pairs of key and time."""
    count = [F.sum((F.col("endpoint") == e).cast("long")).alias(e) for e in ENDPOINTS]
    return refs.groupBy(*_KEY, "at").agg(*count)


_TIMELESS = f"at = cast('{_FIRST}' as timestamp_ntz)"
_LIVES = f"({_TIMELESS} or begun <= at and ended > at)"
_SOUND = f"({_TIMELESS} or real and begun <= at and ended > at)"


def living_instants(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """``k1, k2, at, sound`` of the instants of ``asked(k1, k2, at)`` at which a version lives; ``sound`` if one is no ghost.

    A sweep: running sums of begins and ends within the cells of a range partitioning of (key,
    time), to which the sums of the key's earlier cells are added.
    """
    n = lambda c: F.lit(c).cast("long")
    real = F.col("real").cast("long")
    v = versions.where("ended > begun")
    begins = v.select(*_KEY, F.col("begun").alias("at"), n(1).alias("live"), real.alias("real"), F.lit(False).alias("asked"))
    ends = v.select(*_KEY, F.col("ended").alias("at"), n(-1).alias("live"), (-real).alias("real"), F.lit(False).alias("asked"))
    here = asked.select(*_KEY, "at", n(0).alias("live"), n(0).alias("real"), F.lit(True).alias("asked"))
    marks = begins.unionByName(ends).unionByName(here).groupBy(*_KEY, "at").agg(F.sum("live").alias("live"), F.sum("real").alias("real"), F.max("asked").alias("asked"))
    marks = cut(marks)
    cells = max(int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-marks.count() // CELL))
    marks = cut(marks.repartitionByRange(cells, *_KEY, "at").withColumn("cell", F.spark_partition_id()))
    within = Window.partitionBy(*_KEY, "cell").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*_KEY).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    sums = marks.groupBy(*_KEY, "cell").agg(F.sum("live").alias("live"), F.sum("real").alias("real"))
    sums = sums.select(*_KEY, "cell", F.coalesce(F.sum("live").over(before), n(0)).alias("live0"), F.coalesce(F.sum("real").over(before), n(0)).alias("real0"))
    fine = marks.select(*_KEY, "cell", "at", "asked", F.sum("live").over(within).alias("live"), F.sum("real").over(within).alias("real")).where("asked")
    out = fine.join(sums, [*_KEY, "cell"]).where("live + live0 > 0")
    return out.select(*_KEY, "at", (F.col("real") + F.col("real0") > 0).alias("sound"))


def unsound_instants(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """``k1, k2, at, source, target, kind`` of the pairs of ``asked_instants`` without a sound parent.

    'missing' no parent row has the id; 'late' nothing lives and all rows begin later;
    'deleted' nothing lives otherwise; 'unresolved' all that live are ghosts.
    A reference without time is tested for 'missing' only.
    """
    asked, versions = cut(asked), cut(versions)
    first = cut(versions.groupBy(*_KEY).agg(F.min("begun").alias("first"), F.count("*").alias("n")))
    many = cut(first.where(F.col("n") > VERSIONS).select(*_KEY))
    rows, spans, living = asked, versions, None
    if many.limit(1).count():
        rows, spans = asked.join(many, _KEY, "left_anti"), versions.join(many, _KEY, "left_anti")
        swept = asked.join(many, _KEY, "left_semi")
        timed = swept.where(f"not ({_TIMELESS})")  # a timeless reference to a key that has versions is sound
        living = cut(living_instants(timed, versions.join(many, _KEY, "left_semi")))
    heavy = heavy_shards(cut(asked.groupBy(*_KEY).agg(F.count("*").alias("n"))), _KEY)
    bad = sharded_join(rows, spans, _KEY, heavy, F.col("at"), "left_anti", F.expr(_SOUND))
    if living is not None:
        bad = bad.unionByName(timed.join(living.where("sound"), [*_KEY, "at"], "left_anti"))
    bad = cut(bad)
    if living is None:
        ghosts = sharded_join(bad, spans, _KEY, heavy, F.col("at"), "left_semi", F.expr(_LIVES))
    else:
        ghosts = sharded_join(bad.join(many, _KEY, "left_anti"), spans, _KEY, heavy, F.col("at"), "left_semi", F.expr(_LIVES))
        ghosts = ghosts.unionByName(bad.join(living, [*_KEY, "at"], "left_semi"))
    kind = F.when(F.col("first").isNull(), "missing").when(F.col("ghost"), "unresolved").when(F.col("first") > F.col("at"), "late").otherwise("deleted")
    told = bad.join(ghosts.select(*_KEY, "at", F.lit(True).alias("ghost")), [*_KEY, "at"], "left")
    return sharded_join(told, first.drop("n"), _KEY, heavy, F.col("at"), "left").select(*_KEY, "at", *ENDPOINTS, kind.alias("kind"))


def orphan_references(edges: DataFrame, nodes: DataFrame, externals: DataFrame) -> DataFrame:
    """``ord, endpoint, kind, at``: the unsound non-null ends of ``edges``, one row each.

    Repeated edges are reported each, under their own ``ord``. Empty tables: without parents
    every end is 'missing'; without edges there is no row.
    """
    refs = references(edges)
    bad = cut(unsound_instants(asked_instants(refs), parent_versions(nodes, externals)))
    pair = F.xxhash64(*_KEY, "at")
    some = may_hold(refs, mask_of(bad.select(pair.alias("h"))), pair)
    heavy = heavy_shards(bad.select(*_KEY, "at", (F.col("source") + F.col("target")).alias("n")), [*_KEY, "at"])
    return sharded_join(some, bad.drop(*ENDPOINTS), [*_KEY, "at"], heavy, F.col("ord")).select("ord", "endpoint", "kind", "at")


def orphan_report(edges: DataFrame, nodes: DataFrame, externals: DataFrame, ref_table: str = "edges") -> DataFrame:
    """``ref_table, endpoint, kind, month, n``; the month of a missing time is null."""
    bad = unsound_instants(asked_instants(references(edges)), parent_versions(nodes, externals))
    month = F.when(~F.expr(_TIMELESS), F.date_format("at", "yyyy-MM"))
    ends = F.explode(F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(e).alias("n")) for e in ENDPOINTS]))
    rows = bad.select("kind", month.alias("month"), ends.alias("_e")).select("kind", "month", "_e.endpoint", "_e.n").where("n > 0")
    return rows.groupBy(F.lit(ref_table).alias("ref_table"), "endpoint", "kind", "month").agg(F.sum("n").alias("n"))
