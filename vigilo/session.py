"""Session construction and cluster-safe scratch locations.

Everything in the library is a lazy ``DataFrame -> DataFrame`` function; the
only place that touches session configuration is here.  On a cluster the
session normally exists already (``getOrCreate`` returns it) and its
``spark.checkpoint.dir`` points at a shared file system; we only fill in a
directory when none is configured (local runs and tests).
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job wants: adaptive execution for runtime re-planning
# (coalescing small shuffle partitions, splitting skewed join partitions,
# converting joins to broadcast when the *measured* side is small), UTC as
# the session clock so timestamps match the oracle, and no web UI.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Parquet scans: 128 MiB splits keep task count proportional to data.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_session(master: str | None = None, app: str = "vigilo",
                  shuffle_partitions: int | None = None,
                  conf: dict | None = None) -> SparkSession:
    """Return a session with the library defaults applied.

    ``master`` is only set when given (tests and bench use ``local[N]``; on a
    cluster the launcher decides).  ``shuffle_partitions`` should be sized so
    one shuffle partition holds roughly 100-200 MiB at the target scale; AQE
    coalesces it down when the data turns out smaller.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set one only if unset.

    The fallback (a fresh ``mktemp``-style folder) is for local runs only.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        path = configured
    elif not fallback and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    else:
        path = fallback or tempfile.mkdtemp(prefix="vigilo-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever the driver was started.

    The zip is served to the executors by Spark itself, once per context.
    """
    sc = spark.sparkContext
    if getattr(sc, "_vigilo_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="vigilo-pkg-"), "vigilo.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._vigilo_shipped = True


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint location for written tables, removed when the driver's Python ends."""
    path = ensure_checkpoint_dir(spark).rstrip("/") + "/" + name
    atexit.register(remove_dir, spark, path)
    return path


def delete_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark uses for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.delete(target, True) and fs.exists(target):
        raise OSError(f"could not delete {path}")


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder; quiet where the session has ended, as nothing depends on it."""
    with contextlib.suppress(Exception):
        delete_dir(spark, path)
