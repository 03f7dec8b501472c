"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  Timestamps are compared with other engines
# in UTC; AQE re-plans joins and coalesces shuffle partitions at runtime and
# splits skewed join partitions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Arrow batches to Python: bounded by bytes (documents can be large)
    # and by records (small rows amortise the per-batch cost).
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "quire", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks.  On a cluster, use the
    session the platform provides and only call :func:`ensure_defaults`."""
    builder = SparkSession.builder.master(master).appName(app_name)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> None:
    """Apply the session settings the operators assume (idempotent) and
    make the package importable by Python workers (like ``--py-files``)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Zip this package once per SparkContext and add it with addPyFile, so
    executors (and local Python workers) import the same code."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quire-pyfiles-"), "quire.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cutting lineage.

    The cluster names it in ``spark.checkpoint.dir``; we only pick a local
    one when it is unset and the master is ``local[*]`` (tests).  On a
    cluster without the setting this raises instead of using a machine-local
    folder."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return str(current)
    if configured:
        sc.setCheckpointDir(configured)
        return str(configured)
    if not sc.master.startswith("local"):
        # A machine-local folder would not survive the loss of an executor
        # (or be visible to the others): the cluster must name a shared one.
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store)")
    local = tempfile.mkdtemp(prefix="quire-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return local


def cut(df):
    """Reliable checkpoint in the shared folder: a result that several steps
    read is made once and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name):
    """`df` as a Parquet table in the shared folder: made once, and later
    reads take only the columns they need."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
