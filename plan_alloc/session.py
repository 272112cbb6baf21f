"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one task of a join, an aggregation or a sort of planning rows.
ROWS_PER_TASK = 500_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "plan_alloc") -> SparkSession:
    """Local session with AQE on and the web UI off (no listening page)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PLAN_ALLOC_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def spread(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``df``, of some ``rows`` rows, hash-partitioned by ``columns`` with at most
    about ``ROWS_PER_TASK`` of them in a task whatever the session's number of
    shuffle partitions (fewer rows use up to that number). Rows that one task can
    take are left for Spark to deal as it needs them."""
    if rows <= ROWS_PER_TASK:
        return df
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(-(-rows // ROWS_PER_TASK), min(usual, -(-rows // (ROWS_PER_TASK // 5))))
    return df.repartition(n, *columns)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    Uses the folder the cluster names in ``spark.checkpoint.dir`` (or one already
    set on the context). Only a local-mode session without one gets a private
    temporary folder; on a cluster a missing setting is an error, since a
    machine-local folder would not survive the loss of that machine.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context on the client, use the setting
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("Set spark.checkpoint.dir to a shared folder for this session.") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="plan_alloc_ckpt_")
        sc.setCheckpointDir(folder)
        return sc.getCheckpointDir() or folder
    raise RuntimeError("Set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster.")


# Folders written by ``materialize`` and not yet removed, per session.
_WRITTEN: dict[int, list[str]] = {}
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Those that the end of the driver's Python removes: nobody else knows when their last reader is done.
_KEPT: dict[str, SparkSession] = {}


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: cuts the lineage, and every later read sees exactly these rows
    (columnar and compressed, unlike an RDD checkpoint)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/plan_alloc_{label}_{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    _WRITTEN.setdefault(id(spark), []).append(path)
    return spark.read.parquet(path)


def written(spark: SparkSession) -> list[str]:
    """Folders ``materialize`` wrote for this session and not yet removed."""
    return list(_WRITTEN.get(id(spark), []))


def remove_written(spark: SparkSession, paths: list[str]) -> None:
    """Delete materialized folders (through the Hadoop file system of each
    path, so HDFS/S3/local alike) once nothing reads them any more. Under
    Spark Connect the client cannot reach the file system: the folders are
    left to the checkpoint folder's retention."""
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:
        return
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in _WRITTEN.get(id(spark), []):
            _WRITTEN[id(spark)].remove(path)


def keep(df: DataFrame, label: str, clean: bool = False) -> DataFrame:
    """``materialize`` for a frame that a returned lazy frame reads: its folder is
    removed by ``forget`` or when the driver's Python ends. ``clean``: what the
    write shuffled is deleted with its end, instead of when the driver collects garbage."""
    spark = df.sparkSession
    if not _KEPT:
        atexit.register(_clean)
    before = set(written(spark))
    was = spark.conf.get(_FILE_CLEANUP, None)
    if clean:
        spark.conf.set(_FILE_CLEANUP, "true")
    try:
        kept = materialize(df, label)
    finally:
        if clean:
            spark.conf.set(_FILE_CLEANUP, was) if was is not None else spark.conf.unset(_FILE_CLEANUP)
    kept.kept_at = next(p for p in written(spark) if p not in before)
    _KEPT[kept.kept_at] = spark
    return kept


def forget(*frames: DataFrame) -> None:
    """Delete what ``keep`` wrote for these frames; nothing may read them any more."""
    for frame in frames:
        remove_written(_KEPT.pop(frame.kept_at), [frame.kept_at])


def _clean() -> None:
    for path, spark in list(_KEPT.items()):
        try:
            remove_written(spark, [path])
        except Exception:  # the session has ended: the checkpoint folder's own retention applies
            return


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared checkpoint folder (registered, so
    ``remove_written`` can delete it)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/plan_alloc_{label}_{uuid.uuid4().hex}"
    _WRITTEN.setdefault(id(spark), []).append(path)
    return path
