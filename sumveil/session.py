"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sumveil", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SUMVEIL_DRIVER_MEMORY", "12g"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per session.

    Functions that run in Python workers are found there by name.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_sumveil_shipped", False) or not os.path.isdir(root):
        return
    folder = tempfile.mkdtemp(prefix="sumveil-source-")
    target = os.path.join(folder, "sumveil.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), os.path.dirname(root)))
    sc.addPyFile(target)
    sc._sumveil_shipped = True


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by columns into the session's full number of shuffle partitions.

    Adaptive execution merges small partitions by bytes, which would leave stages
    whose cost is in computing (ciphers) to a few tasks; an explicit number is kept.
    Joins and groupings on the same columns need no further exchange.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def spread_files(df: DataFrame, path: str, *cols: str, part_bytes: int = 16 << 20) -> DataFrame:
    """Hash-partition what was read from ``path`` into one partition per ``part_bytes`` of its files, or the session's number if that is more.

    A group-by on about as many groups as rows holds them in memory; here a task's groups do not grow with the input.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes)), *cols)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared checkpoint folder the session names.

    Written tables and stream checkpoints must be visible to every executor, so
    the cluster's ``spark.checkpoint.dir`` decides.  Only on a local master, where
    driver and executors are one process, a temporary folder is made if it is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sumveil-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate that several branches read, and read it back.

    The table lies in the shared scratch folder: branches do not repeat the work, and
    a lost executor costs no recomputation of what came before.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
