"""Session-level helpers: reading tables, cutting lineage, spreading small inputs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; a local one only where nothing is set and all executors are this process.

    On a cluster without a named folder this is an error: a machine's own folder would lose data with the machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="codelattice-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The files are replicated/shared storage, so the loss of an executor costs at most the
    running tasks; they are never kept in executor memory only.

    A checkpoint keeps the size that was estimated for it. In a loop of joins these estimates
    multiply, to numbers so long that planning takes minutes, so the rows are taken over
    without them.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, for tables that live as long as the application."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that Python stages find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_codelattice_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="codelattice-package-"), "codelattice.zip")  # copied to the executors by Spark
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("codelattice", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._codelattice_shipped = True


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Repartition only if the scan yields fewer splits than the cluster has slots.

    Small files are often one split, which would put a costly per-row stage on one core.
    At scale the scan has many splits and this is the identity, without a shuffle. A plan with
    exchanges is left alone: its number of partitions is only known once it has run.
    """
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots * factor) if df.rdd.getNumPartitions() < slots else df
