"""Tables written to the shared folder of the cluster, to cut lineage.

A staged table is computed once, is readable by every executor and survives
the loss of any of them. It lives below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_watched: list[list[DataFrame]] = []


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder. A session without one gets its own, which only local mode can read; a cluster has to name one."""
    root = spark.conf.get(KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} names no folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="parley-shared-")
        spark.conf.set(KEY, root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/parley/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._parley_path = path
    for tables in _watched[-1:]:
        tables.append(out)
    return out


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables staged inside at the end, but for those handed to the function it gives."""
    tables, spared = [], []
    _watched.append(tables)

    def spare(df: DataFrame) -> DataFrame:
        spared.append(df)
        return df

    try:
        yield spare
    finally:
        _watched.remove(tables)
        for df in tables:
            if not any(df is s for s in spared):
                discard(df)


def discard(df: DataFrame) -> None:
    """Delete a staged table that no later job reads."""
    path = getattr(df, "_parley_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
