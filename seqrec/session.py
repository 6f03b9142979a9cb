"""Session helpers: builder for local runs and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


#: Scratch paths handed out, by application.
_made: dict[str, list[str]] = {}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "seqrec") -> SparkSession:
    """Session used by tests and bench; a cluster passes its own session."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage and round-trip files.

    Uses the cluster's ``spark.checkpoint.dir`` (or the checkpoint folder
    already set on the context).  A local session without either gets a fresh
    temporary folder, removed when the driver ends; any other session must
    name a folder that all its machines share.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    local = tempfile.mkdtemp(prefix="seqrec-ckpt-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the scratch root (never reused)."""
    root = scratch_root(spark).rstrip("/")
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there; a failure to look raises."""
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def clear_scratch(spark: SparkSession) -> None:
    """Removes the tables that ``cut`` and ``scratch_path`` have made in this session."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        fs, where = _file_system(spark, path)
        fs.delete(where, True)


def cut(df, name: str = "cut"):
    """Materialise a frame that several branches reuse, cutting its lineage.

    Written once as a Parquet table in the shared checkpoint folder and read
    back: survives the loss of executors (unlike a local checkpoint), is
    computed by a single job, and gives the optimizer real file statistics.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each Spark context, so that tasks can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_seqrec_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="seqrec-src-"), "seqrec_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._seqrec_shipped = True
