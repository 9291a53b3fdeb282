"""Session helpers.

The library never creates a global session: every operator takes DataFrames
and returns DataFrames.  These helpers only build a session for tests, the
bench and the driver, and resolve the shared checkpoint folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults sized for a large cluster; tests and the bench override
# shuffle partitions for local mode.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # vectors of width 2048 are 8 KB a side: keep Arrow batches near 32 MB
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "prefspark") -> SparkSession:
    """A local-mode session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in CLUSTER_CONF.items():
        builder = builder.config(key, value)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g")
               .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024)))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_library(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, work_dir: str | None = None) -> str:
    """Return the folder for checkpoints and scratch tables.

    ``spark.checkpoint.dir`` names the cluster's shared folder and is used as
    is; ``work_dir`` is for sessions that do not set it.  With neither, a
    ``local[...]`` master gets a private temporary folder; any other master
    raises, because a machine-local folder would scatter the tables over
    node disks.  The setting itself is never written.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or work_dir or sc.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[[^]]*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir (or pass work_dir): a cluster needs a shared folder")
        current = tempfile.mkdtemp(prefix="prefspark-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table.

    Nothing is created here: Spark's writer creates the folder on whatever
    file system the checkpoint folder lives on.  ``clear_scratch`` removes
    the tables of this application.
    """
    sc = spark.sparkContext
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{sc.applicationId}"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table this application has written.

    Call it when no DataFrame built on them is needed any more (results are
    lazy, so an operator cannot do it by itself).
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "x")).getParent()
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written table, if there is one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship_library(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, as ``--py-files``
    would: a zip of the package is added with ``addPyFile`` once per
    context (its name carries a content hash, so an edited package is
    shipped again)."""
    import hashlib
    import os
    import zipfile

    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".py"))
    digest = hashlib.sha1()
    for f in files:
        digest.update(f.encode())
        with open(f, "rb") as fh:
            digest.update(fh.read())
    tag = digest.hexdigest()[:16]
    if getattr(sc, "_prefspark_shipped", None) == tag:
        return
    out = os.path.join(tempfile.gettempdir(), f"prefspark-{tag}.zip")
    if not os.path.exists(out):
        tmp = out + f".{os.getpid()}.part"
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f, os.path.relpath(f, os.path.dirname(root)))
        os.replace(tmp, out)
    sc.addPyFile(out)
    sc._prefspark_shipped = tag


def write_and_read(df, name: str):
    """Cut lineage with a written table: ``df`` is written once as parquet
    under the shared checkpoint folder and read back (readers prune columns;
    a lost executor recomputes nothing upstream)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # the schema is known: no job to infer it
