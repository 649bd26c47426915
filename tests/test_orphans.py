from datetime import datetime

from codelattice.operators.orphans import orphan_references, orphan_report

NODES = "id string, scanned_at timestamp_ntz, removed_at timestamp_ntz, unresolved boolean, name string, kind string"
EXT = "id string, added_at timestamp_ntz, withdrawn_at timestamp_ntz"
EDGES = "ord long, source string, target string, scanned_at timestamp_ntz, id string, kind string"


def t(day, hour=0):
    return datetime(2024, 1, day, hour)


def found(spark, nodes, ext, edges):
    e = spark.createDataFrame(edges, "ord long, source string, target string, scanned_at timestamp_ntz")
    n = spark.createDataFrame(nodes, "id string, scanned_at timestamp_ntz, removed_at timestamp_ntz, unresolved boolean")
    x = spark.createDataFrame(ext, EXT)
    return {tuple(r) for r in orphan_references(e, n, x).drop("at").collect()}


def test_kinds_of_orphans(spark):
    nodes = [
        ("a", t(1), None, None), ("b", t(5), None, False), ("c", t(1), t(3), None), ("c", t(20), None, None), ("g", t(1), None, True),
        ("g", t(9), None, None), ("x\\y", t(1), None, None), ("odd", t(8), t(2), None),
    ]
    ext = [("p", t(1), t(4))]
    edges = [
        (1, "a", "b", t(2)), (2, "a", "c", t(2)), (3, "a", "c", t(3)), (4, "a", "g", t(5)), (5, "a", "g", t(9)), (6, "x/y", "nowhere", t(5)),
        (7, "p", "p", t(3, 23)), (8, "p", "p", t(4)), (9, None, None, t(4)), (10, "odd", "a", t(9)), (11, "a", "b", t(5)),
    ]
    assert found(spark, nodes, ext, edges) == {
        (1, "target", "late"), (3, "target", "deleted"), (4, "target", "unresolved"), (6, "target", "missing"),
        (8, "source", "deleted"), (8, "target", "deleted"), (10, "source", "deleted"),
    }


def test_nulls_and_ties(spark):
    nodes = [("a", None, None, None), (None, t(1), None, None), ("b", t(1), None, True), ("b", t(1), None, False)]
    edges = [(1, "a", "b", t(2)), (1, "a", "b", t(2)), (2, "b", "zz", None), (3, "a", "b", None)]
    # A parent without begin comes late; a reference without time is only tested for missing keys; repeated rows each count.
    assert found(spark, nodes, [], edges) == {(1, "source", "late"), (2, "target", "missing")}


def test_empty_tables_and_clashing_names(spark):
    e = spark.createDataFrame([(1, "a", "b", t(2), "x", "y")], EDGES)
    n = spark.createDataFrame([], NODES)
    x = spark.createDataFrame([], EXT + ", kind string")
    assert {tuple(r) for r in orphan_references(e, n, x).drop("at").collect()} == {(1, "source", "missing"), (1, "target", "missing")}
    assert orphan_references(e.limit(0), n, x).count() == 0
    assert [tuple(r) for r in orphan_report(e, n, x).orderBy("endpoint").collect()] == [("edges", "source", "missing", "2024-01", 1), ("edges", "target", "missing", "2024-01", 1)]


def test_hot_key_with_many_instants(spark):
    from pyspark.sql import functions as F

    n = spark.createDataFrame([("h", t(1), t(20), None), ("h", t(25), None, None)], "id string, scanned_at timestamp_ntz, removed_at timestamp_ntz, unresolved boolean")
    e = spark.range(20000).select(F.col("id").alias("ord"), F.lit("h").alias("source"), F.lit(None).cast("string").alias("target"),
                                  F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, cast(id * 2 as int))").alias("scanned_at"))
    x = spark.createDataFrame([], EXT)
    got = {r["ord"] for r in orphan_references(e, n, x).collect()}
    want = {r["ord"] for r in e.where("scanned_at >= timestamp_ntz '2024-01-20' and scanned_at < timestamp_ntz '2024-01-25'").collect()}
    assert got == want and got


def test_hot_key_with_one_instant(spark):
    from pyspark.sql import functions as F

    n = spark.createDataFrame([("a", t(1), None, None)], "id string, scanned_at timestamp_ntz, removed_at timestamp_ntz, unresolved boolean")
    e = spark.range(30000).select(F.col("id").alias("ord"), F.lit("a").alias("source"), F.when(F.col("id") % 3 < 2, "gone").alias("target"), F.lit(t(4)).cast("timestamp_ntz").alias("scanned_at"))
    x = spark.createDataFrame([], EXT)
    assert orphan_references(e, n, x).count() == 20000
    assert [tuple(r) for r in orphan_report(e, n, x).collect()] == [("edges", "target", "missing", "2024-01", 20000)]


def test_long_histories_are_swept(spark, monkeypatch):
    import random

    from codelattice.operators import orphans

    rnd = random.Random(3)
    rows = lambda: [(rnd.choice("abcd"), b := t(rnd.randint(1, 25), rnd.randint(0, 23)), rnd.choice([None, t(rnd.randint(1, 28))]), rnd.choice([None, True, False])) for _ in range(60)]
    nodes = rows() + [("e", t(3), t(9), None)]
    edges = [(k, rnd.choice("abcdef"), rnd.choice("abcdef"), rnd.choice([None, t(rnd.randint(1, 28), rnd.randint(0, 23))])) for k in range(150)]
    want = found(spark, nodes, [("d", t(2), t(4))], edges)
    monkeypatch.setattr(orphans, "VERSIONS", 3)
    assert found(spark, nodes, [("d", t(2), t(4))], edges) == want and {k for *_, k in want} == {"missing", "late", "deleted", "unresolved"}


def test_anti_join_in_the_plan(spark):
    from codelattice.operators.orphans import asked_instants, parent_versions, references, unsound_instants

    d = "/root/testdata/sf0.001"
    e, n, x = (spark.read.parquet(f"{d}/{name}.parquet") for name in ("edges", "nodes", "externals"))
    seen = []
    from codelattice.operators import orphans

    keep = orphans.cut
    orphans.cut = lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df)
    try:
        unsound_instants(asked_instants(references(e)), parent_versions(n, x))
    finally:
        orphans.cut = keep
    assert any("LeftAnti" in p for p in seen)
