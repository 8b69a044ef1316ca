"""Session helper.

On a cluster the session comes from the platform and already names a shared
``spark.checkpoint.dir``; we only read it. Tests and local runs get a session with
UTC time, AQE on, Arrow on and the Spark UI off.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "folio",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.folio.spreadSmallTables", "true")
        .config("spark.driver.memory", os.environ.get("FOLIO_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A session on one machine (``local[...]``, as in tests) gets a fresh folder where none is set.
    On a cluster a folder of one machine would lose files, so a missing setting is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="folio-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written intermediate table."""
    return f"{checkpoint_dir(spark)}/{name}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``folio`` importable in Python workers (once per SparkContext).

    Functions run by ``mapInPandas``/``applyInPandas`` are pickled by reference to this
    package; workers on other machines need the code, so it is zipped and added with
    ``addPyFile`` (Spark distributes it to every executor).
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="folio-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "folio"), "zip", os.path.dirname(pkg_dir), "folio")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What runs inside gives its shuffle files back as it ends; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df, name: str = "table"):
    """Cut the lineage of an intermediate used several times: a reliable ``checkpoint`` in the
    shared checkpoint folder. Nothing stays in the session's cache, so a later equal plan reads
    its inputs anew."""
    checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df, name: str = "table", by: str | None = None):
    """As :func:`materialize`, for large tables: written as Parquet, which packs them, and read back by columns. ``by``: a
    column whose values get a folder each, so that a filter on it reads no others."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    with shuffles_dropped(df.sparkSession):
        w = df.write.option("compression", "zstd")
        (w.partitionBy(by) if by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables) -> None:
    """Remove tables made by :func:`stored` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
