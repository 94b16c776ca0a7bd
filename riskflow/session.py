"""Session construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every riskflow job relies on. Time zone matters for any timestamp rendering;
# feature arithmetic itself is zone-free (see functions/timecols.py).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpointed ranges and feature tables are deleted once no DataFrame refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  extra: dict | None = None, app: str = "riskflow") -> SparkSession:
    """Session builder. ``shuffle_partitions`` and the driver's memory are set for local masters only.

    On a cluster pass ``master=None``: sizes then come from spark-submit and its configuration files.
    """
    builder = SparkSession.builder.appName(app)
    conf = dict(BASE_CONF)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
            conf["spark.driver.memory"] = os.environ.get("RISKFLOW_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared filesystem every executor can reach). Only a
    local-mode session without the setting gets a private folder, which is then registered
    with the SparkContext so ``DataFrame.checkpoint()`` writes there too.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
        return d.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="riskflow-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir().rstrip("/")


_SCRATCH: list[tuple] = []


def _clean_scratch() -> None:
    """Delete this process's scratch folders; the JVM outlives a stopped session until Python ends."""
    for target, conf in _SCRATCH:
        try:
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already; nothing can be deleted then
            return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder, deleted when the process ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.register(_clean_scratch)
    _SCRATCH.append((spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's file-system API (any scheme); a missing one is fine."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whichever file system its scheme names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``riskflow`` importable in Python workers (pandas UDFs, state processors).

    Zips the package once per application into a temporary file of the driver; ``addPyFile`` serves
    it to every executor, also to those that join later, so no shared folder is involved.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="riskflow-ship-"), f"riskflow-{app}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(app)
