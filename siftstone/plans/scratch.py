"""Scratch tables in the folder all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Where that is unset and the session is local (tests, a laptop) a
folder is made for the session and set; a cluster must name one, as its executors share no temporary folder. Tables
written here cut the lineage and survive the loss of an executor, which a local checkpoint would not.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder, without a trailing slash."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        option = sc._jsc.sc().getCheckpointDir()
        root = option.get() if option.isDefined() else None
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siftstone-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder, removed when the driver ends."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    given = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/siftstone/{name}-{uuid.uuid4().hex}")
    path = given.getFileSystem(conf).makeQualified(given).toString()  # Python workers need the scheme, too
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; the folder then belongs to the cluster's clean-up
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the scratch folder and return the table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
