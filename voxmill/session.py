"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting (4.1) that drops an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the tables of ``stored_once`` lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def build_session(app: str = "voxmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package is written for.

    On a cluster leave ``master`` unset and size shuffle partitions and memory through
    ``spark-submit``; everything here is a safe default, not a tuning.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder for written tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where every
    task sees the same disk, may fall back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    root = spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxmill-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows may use it several
    times, and a lost executor costs no recomputation. Shuffle files of the write go when
    it has ended, not when the driver happens to collect garbage, so a job of many steps
    needs the disk of its largest one."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.parquet(path)
    _paths[table] = path
    return table


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables that ``stored_once`` returned. For those that only steps which have
    ended read: what is still to run must not depend on them."""
    for table in tables:
        spark, path = table.sparkSession, _paths.pop(table)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
