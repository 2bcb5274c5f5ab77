"""Session set-up, shared scratch storage and size-checked broadcasting."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only if its files were written and found at or below this many bytes.
BROADCAST_BYTES = 16 << 20

# Rows and bytes of an Arrow batch on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def build_session(app: str = "colonnade", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of ``spark``, so that they need no copy of the repository.

    Sent once per application and content; Spark's own file server delivers the archive. Arrow batches left at
    Spark's default size are made smaller, since rows here can hold whole documents or blocks of rows.
    """
    for name, usual, own in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", own)
    root = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(root)
    if not os.path.isdir(root):
        return spark  # already running from an archive
    files = sorted(
        os.path.join(folder, name) for folder, _, names in os.walk(root) for name in names if name.endswith(".py")
    )
    content = {os.path.relpath(path, top): open(path, "rb").read() for path in files}
    mark = hashlib.sha256(repr(sorted(content.items())).encode()).hexdigest()[:16]
    context = spark.sparkContext
    if getattr(context, "_colonnade_package", None) != mark:
        archive = os.path.join(tempfile.mkdtemp(prefix="colonnade-package-"), f"colonnade-{mark}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path, body in content.items():
                out.writestr(path, body)
        context.addPyFile(archive)
        context._colonnade_package = mark
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="colonnade-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and where it lies."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_table(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that no later step reads."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives lost executors and, unlike a checkpointed plan, brings its true size to
    the next join, so small results are broadcast and sizes do not multiply over loop rounds.
    """
    return keep_table(df, "step")[0]


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: few files would leave cores idle where rows multiply."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written once and marked for broadcast if its files have at most ``limit`` bytes.

    The decision reads the size of the files, so nothing is collected and the side is not computed again.
    """
    path = scratch_path(df.sparkSession, "side")
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return F.broadcast(kept) if files.getContentSummary(target).getLength() <= limit else kept
