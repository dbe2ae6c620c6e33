"""Tables in the folder that driver and executors share, for jobs of several rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def work_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may go without it; it gets a folder of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="skein-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Paths of the tables that saved() wrote inside settled(), innermost last.
_OPEN: list[list[str]] = []


def saved(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: what follows depends on files, not on df's lineage."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/skein-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written; the tables that were written on the way to it are deleted."""
    _OPEN.append([])
    try:
        out = make()
        paths, _OPEN[-1] = _OPEN[-1], []
        out = saved(out)
    finally:
        kept = _OPEN.pop()
        if _OPEN:
            _OPEN[-1].extend(kept)
    for path in paths:
        _delete(spark, path)
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by saved() that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/skein-" in name:
            _delete(spark, name)
