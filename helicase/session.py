"""Session construction and cluster-safe lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# With it the shuffle files of a written table go when it is written; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "helicase", master: str | None = None, cpus: int = 8) -> SparkSession:
    """A session with the settings the operators were planned for.

    On a cluster leave ``master`` to spark-submit; shuffle partitions are then
    left to AQE coalescing from a high initial number.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        b = b.config("spark.sql.shuffle.partitions", str(cpus))
        b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        b = b.config("spark.driver.memory", "16g")
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point Spark's reliable checkpoints at the folder the cluster names.

    ``spark.checkpoint.dir`` wins whenever it is set. Only a local master may
    fall back to a scratch folder, which goes when the program ends; a cluster without the setting is an error,
    because a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        scratch = tempfile.mkdtemp(prefix="helicase-ckpt-")
        atexit.register(shutil.rmtree, scratch, ignore_errors=True)
        sc.setCheckpointDir(scratch)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so iterative jobs survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{ensure_checkpoint_dir(spark)}/helicase-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage", spread: int = 0) -> DataFrame:
    """Write an intermediate result as a table in the shared folder and read it back.

    For results that several branches of a plan consume: they are computed once,
    survive the loss of executors, and keep column pruning and size statistics,
    from which Spark picks broadcast or shuffle joins. ``spread`` asks for that
    many files per core, for tables whose rows expand into far more work than
    their bytes suggest. What the table's plan shuffled is removed from the
    executors' disks as soon as it is written.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if spread:
        df = df.repartition(spread * spark.sparkContext.defaultParallelism)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)
