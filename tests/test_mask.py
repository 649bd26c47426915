from pyspark.sql import functions as F

from codelattice.functions.mask import MASK_BITS, mask_of, may_hold, packed_mask


def test_mask_holds_all_and_little_more(spark):
    some = spark.range(0, 3000).select(F.xxhash64("id").alias("h")).unionByName(spark.createDataFrame([(None,), (-1,), (0,), (2**63 - 1,), (-(2**63),)], "h long"))
    rows = spark.range(0, 200000).select("id", F.when(F.col("id") % 7 != 3, F.xxhash64("id")).alias("k"))
    got = {r["id"] for r in may_hold(rows, mask_of(some), F.col("k")).collect()}
    want = {k for k in range(3000) if k % 7 != 3}
    assert want <= got and len(got - want) < 60 and may_hold(rows, mask_of(some), F.col("k")).columns == ["id", "k"]
    m = packed_mask(some)
    bits = [r["h"] % (1 << MASK_BITS) for r in some.where("h is not null").collect()]
    assert len(m) == 1 << (MASK_BITS - 6) and all(int(m[b >> 6]) >> (b & 63) & 1 for b in bits)
    assert may_hold(rows, mask_of(some.limit(0)), F.col("k")).count() == 0
