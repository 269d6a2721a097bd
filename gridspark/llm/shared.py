"""Shared-folder tables and small helpers used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names.  Only where that is unset and all tasks run in this
    process (tests, a laptop) a temporary folder of this machine takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gridspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, with the scheme of its file system; the JVM removes it when it ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gridspark/{what}-{uuid.uuid4().hex}")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(at)
    return system.makeQualified(at).toString()


def unclashing(*names: str) -> list[str]:
    """Column names that no table has."""
    own = uuid.uuid4().hex[:12]
    return [f"{name}_{own}" for name in names]


def packed(rows: DataFrame, run: Callable, schema: str, most: int = 1 << 22) -> DataFrame:
    """``mapInArrow`` whose many small batches are joined to larger ones."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size > most or len(held) >= 2000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return rows.mapInArrow(joined, schema)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the running tasks, not the whole history, and the
    plan is computed once (an RDD checkpoint would compute it twice).
    """
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
