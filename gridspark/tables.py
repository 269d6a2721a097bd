"""Small and shared tables: what is computed once and used by many steps of a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that the driver holds and sends along with a plan, at most (axes and weights have a few dozen bytes a row).
MOST_LOCAL = 50_000
#: Rows of a written table that is broadcast, at most.
MOST_BROADCAST = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only where that is unset and all tasks run in this process a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gridspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so no plan computes it again; the JVM removes it when it ends."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gridspark/{what}-{uuid.uuid4().hex}")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(at)
    path = system.makeQualified(at).toString()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, what: str) -> DataFrame:
    """``df`` computed once.

    Up to ``MOST_LOCAL`` rows become a local table, whose exact size Spark knows and which it broadcasts
    by itself; in one partition, so windows and sums over it need no exchange.  A larger one is written to the shared folder, and broadcast up to ``MOST_BROADCAST`` rows.
    """
    rows = df.limit(MOST_LOCAL + 1).toArrow()
    if rows.num_rows <= MOST_LOCAL:
        return df.sparkSession.createDataFrame(rows, schema=df.schema).coalesce(1)  # a local relation: no Python worker reads it
    written = materialize(df, what)
    return F.broadcast(written) if written.count() <= MOST_BROADCAST else written


def remove(df: DataFrame) -> None:
    """Deletes the files behind a written table."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def listing(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern names, in any file system Spark reads, in order; a folder stands for itself."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    paths = sorted(s.getPath().toString() for s in found)
    return paths if "://" in pattern or pattern.startswith("file:") else [p.removeprefix("file:") for p in paths]
