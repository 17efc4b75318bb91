"""Session settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package relies on. AQE re-plans joins from measured sizes, so a side is
# broadcast only when it is small, and it splits hot join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles methods above 8,000 bytes of bytecode. Wide projections and aggregates pass
    # that limit when fused into one method and then run interpreted, several times slower; below it Spark
    # splits them into methods the JVM does compile.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# Folders of local sessions that name none, by application.
_local_folders: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that was built elsewhere.

    Python workers find this package where the driver found it, unless they have it otherwise.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def local_session(
    cores: int | str = "*", app: str = "synthspark", shuffle_partitions: int = 8, checkpoint_dir: str | None = None
) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach.

    Taken from ``spark.checkpoint.dir``. Only a local-mode session that names none gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="synthspark-")
    return _local_folders[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder; nothing exists there yet."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """Write once to the shared folder and read back: later steps neither recompute nor inline the plan."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
