"""Tables in the folder that driver and executors share: cutting lineage without a copy on one machine."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and Spark runs in one JVM (tests), a local folder is made for it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not hasattr(spark, "_palimpsest_dir"):
            spark._palimpsest_dir = tempfile.mkdtemp(prefix="palimpsest-")
        folder = spark._palimpsest_dir
    return folder.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application alone writes to."""
    return f"{shared_dir(spark)}/palimpsest/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: the lineage ends there.

    A lost executor costs no recomputation beyond that table. The files stay until `dropped` or `clean`.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.staged_path = path
    return made


#: Keys that may be broadcast.
MOST_BROADCAST = 1 << 20


def short_list(keys: DataFrame) -> DataFrame:
    """keys (one column) to be broadcast if there are at most MOST_BROADCAST of them, else as it is; the result of a join is the same."""
    keys = staged(keys, "keys")
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder in any store that Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `staged` has made and no result reads any more."""
    for df in tables:
        if path := getattr(df, "staged_path", None):
            delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has staged; call it when the results that read it are written."""
    delete(spark, own_dir(spark))
