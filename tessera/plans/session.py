"""Session settings that plans rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir; only where neither that nor one is set and all runs on this machine (tests), to a new local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="tessera-checkpoints-")
        atexit.register(shutil.rmtree, where, True)
    sc.setCheckpointDir(where)


def build_session(name: str = "tessera", **settings) -> SparkSession:
    """A session with adaptive execution, skew handling and Arrow on; ``settings`` (dots as __) come last."""
    b = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    for k, v in (defaults | {k.replace("__", "."): str(v) for k, v in settings.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def spread(df):
    """``df`` dealt out to all cores where its input has fewer splits than that (a single small file); larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def bounded(df, most: int = 200_000):
    """``df`` marked for broadcast if it has been counted to have ``most`` rows at most, else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once for each application, so that they find it wherever they start."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):
        folder = tempfile.mkdtemp(prefix="tessera-package-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "tessera_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for where, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(where, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(path)
    sc._tessera_shipped = True
