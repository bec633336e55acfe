"""Spark session defaults.

On a cluster the session is created by the platform; we only fill in settings
that are unset, so cluster-provided values (shuffle partitions, checkpoint
dir, broadcast threshold) always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings applied only when the session does not already define them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULTS where unset, make sure a checkpoint dir is known and let the workers import this package."""
    conf = spark.conf
    for key, value in DEFAULTS.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    checkpoint_dir(spark)
    return ship_sources(spark)


def ship_sources(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the executors, once a session, so that tasks can import it from anywhere."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session ships its own artifacts
        return spark
    if getattr(sc, "_outagelens_shipped", False):
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(), "outagelens-sources.zip")  # Spark's file server hands it out
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(target)
    sc._outagelens_shipped = True
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  Only
    a local-mode session where neither is set gets a fresh scratch folder; on a
    cluster a machine-local folder would lose data, so a missing setting raises.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session
        sc = None
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path:
        if not (sc.master if sc is not None else "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="outagelens-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # noqa: BLE001 - conf not settable at runtime
            pass
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def run_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder for one run's table or export."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "outagelens") -> SparkSession:
    """Session for tests and the local bench (local mode, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("OUTAGELENS_DRIVER_MEM", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
