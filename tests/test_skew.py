from collections import Counter

from pyspark.sql import functions as F

from codelattice.operators import skew as S
from codelattice.session import cut


def test_plan_balances_a_key_with_a_third_of_all_rows(spark):
    rows = [("hot", 3000)] + [(f"k{i}", 10) for i in range(600)] + [(None, 5)]
    plan = S.plan_loads(spark.createDataFrame(rows, "key string, n long"), 8)
    assert len(plan.heavy["hot"]) >= 4 and max(plan.loads) < 1.4 * sum(plan.loads) / 8
    assert len(set(plan.heavy["hot"])) > 2


def test_balanced_join_equals_plain_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"), F.col("id").alias("row"), F.lit(1).alias("name"))
    right = spark.createDataFrame([("hot", "H", 1), ("k1", "A", 2), ("k1", "B", 3), ("zz", "Z", 4), (None, "N", 5)], "key string, value string, name int")
    plan = S.plan_loads(cut(left.groupBy("key").agg(F.count("*").alias("n"))), 4)
    for how in ("inner", "left", "left_semi"):
        got = S.balanced_join(left, right, plan, "key", F.col("row"), how).drop("_bin")
        want = left.join(right.drop("name"), "key", how)
        assert Counter(map(tuple, got.select(*sorted(got.columns)).collect())) == Counter(map(tuple, want.select(*sorted(want.columns)).collect())), how
    moved = S.fragment(left, plan, "key", F.col("row")).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in moved) < 1.5 * 3000 / 4


def test_report(spark):
    e = spark.createDataFrame([("s1", "t"), ("s1", "t"), ("s2", "t"), (None, "t"), ("s2", "x\\y"), ("t", None), ("s3", "x/y")], "source string, target string")
    n = spark.createDataFrame([("t", 1, None, "T", "function"), ("t", 2, None, "T2", "class"), (None, 3, None, "N", "class")], "id string, ord long, scanned_at timestamp, name string, type string")
    x = spark.createDataFrame([("x/y", "XY", "file", "ts")], "id string, name string, type string, lang string")
    got = {r["target"]: tuple(r)[1:] for r in S.target_report(e, n, x, 3).collect()}
    assert got == {"t": ("T2", "class", 4, 2, 5), "x/y": ("XY", "file", 2, 2, 2)}
    assert {r["target"] for r in S.hot_targets(e, n, x, 0.5).collect()} == {"t"}
    assert S.target_report(e.limit(0), n, x, 3).count() == 0
