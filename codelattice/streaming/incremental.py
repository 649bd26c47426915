"""Incremental scans: a stream of file versions upserts the fragments of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILE_SCHEMA = "path string, size bigint, mtime_ms double, hash string, content string"


def newest_versions(files: DataFrame) -> DataFrame:
    """One row per path: the greatest (mtime, size); a null mtime ranks lowest. Combined map-side."""
    rest = [c for c in files.columns if c != "path"]
    order = F.struct(F.coalesce("mtime_ms", F.lit(float("-inf"))).alias("m"), F.coalesce("size", F.lit(-1)).alias("s"), F.coalesce("hash", F.lit("")).alias("h"))
    rows = files.where("path is not null").groupBy(F.translate("path", "\\", "/").alias("path"))
    return rows.agg(F.max_by(F.struct(*rest), order).alias("_r")).select("path", "_r.*")


def upsert(state: DataFrame, batch: DataFrame) -> DataFrame:
    """``state`` with the paths of ``batch`` replaced by their newest versions."""
    new = newest_versions(batch)
    return newest_versions(state.unionByName(new))


def changes(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The newest versions of ``batch`` that ``state`` does not hold with the same size and time."""
    return newest_versions(batch).join(state.select("path", "size", "mtime_ms"), ["path", "size", "mtime_ms"], "left_anti")


def current_fragments(spark: SparkSession, store: str) -> DataFrame:
    """The fragments that ``watch_files`` keeps at ``store``: of each path those of the latest batch that parsed it."""
    rows = spark.read.parquet(f"{store}/fragments")
    rest = [c for c in rows.columns if c not in ("path", "batch")]
    latest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["path", "batch"], "left_semi").select("path", *rest)


def watch_files(spark: SparkSession, source: str, store: str, checkpoint: str, parse) -> StreamingQuery:
    """Follow Parquet files of file versions at ``source``; keep ``store`` up to date, once over what is there.

    Each batch parses only changed files, with ``parse(DataFrame) -> DataFrame`` of fragments
    that have a ``path``, and writes state and fragments under the batch's number; a batch that
    is run again after a failure writes the same folder again, so nothing is applied twice.
    """

    def apply(batch: DataFrame, k: int) -> None:
        s = batch.sparkSession
        state_path = f"{store}/state"
        try:
            state = s.read.parquet(state_path)
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            state = s.createDataFrame([], FILE_SCHEMA + ", batch bigint")
        state = state.where(F.col("batch") != k)
        new = changes(newest_versions(state.drop("batch")), batch)
        parse(new).write.mode("overwrite").parquet(f"{store}/fragments/batch={k}")
        new.drop("content").withColumn("content", F.lit(None).cast("string")).select("path", "size", "mtime_ms", "hash", "content").write.mode("overwrite").parquet(f"{state_path}/batch={k}")

    rows = spark.readStream.schema(FILE_SCHEMA).parquet(source)
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
