"""A bit mask of fixed size that says of a 64-bit hash whether it may be in a set.

It keeps rows that cannot match out of a shuffle. The mask is a broadcast of at most
2^MASK_BITS / 8 bytes whatever the data; the fuller it is, the more rows pass by chance, so a
join has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK_BITS = 26  # 8 MB
_WORDS = 8  # 64-bit words in one row of a mask


def mask_of(hashes: DataFrame, h: str = "h") -> DataFrame:
    """``block, w0 .. w7``: the mask of the 64-bit hashes in column ``h``, at most 2^MASK_BITS / 512 rows."""
    bit = F.pmod(F.col(h), F.lit(1 << MASK_BITS))
    rows = hashes.where(F.col(h).isNotNull()).select(F.shiftright(bit, 9).cast("int").alias("block"), (F.shiftright(bit, 6) % _WORDS).alias("k"), F.expr(f"shiftleft(1L, cast(pmod({h}, 64) as int))").alias("v"))
    words = [F.coalesce(F.bit_or(F.when(F.col("k") == k, F.col("v"))), F.lit(0).cast("bigint")).alias(f"w{k}") for k in range(_WORDS)]
    return rows.groupBy("block").agg(*words)


def may_hold(df: DataFrame, mask: DataFrame, h: Column) -> DataFrame:
    """The rows of ``df`` whose hash ``h`` may be in the set of ``mask``; rows with a null hash are left out."""
    names = {f"w{k}": f"_w{k}" for k in range(_WORDS)}
    rows = df.withColumn("_h", F.pmod(h, F.lit(1 << MASK_BITS)))
    m = F.broadcast(mask.withColumnsRenamed({"block": "_block", **names}))
    out = rows.join(m, F.shiftright("_h", 9).cast("int") == F.col("_block"))
    k = F.shiftright("_h", 6) % _WORDS
    word = F.lit(0).cast("bigint")
    for i in range(_WORDS):
        word = F.when(k == i, F.col(f"_w{i}")).otherwise(word)
    return out.withColumn("_w", word).where("(shiftright(_w, cast(_h % 64 as int)) & 1) = 1").drop("_h", "_block", "_w", *names.values())


def packed_mask(hashes: DataFrame, h: str = "h"):
    """The same bits as one numpy array of 64-bit words, for Python stages; 2^MASK_BITS / 8 bytes reach the driver."""
    import numpy as np

    bit = F.pmod(F.col(h), F.lit(1 << MASK_BITS))
    words = hashes.where(F.col(h).isNotNull()).select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({h}, 64) as int))").alias("v"))
    got = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    mask = np.zeros(1 << (MASK_BITS - 6), dtype=np.int64)
    mask[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return mask.view(np.uint64)
