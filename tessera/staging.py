"""Tables written in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, where it is unset, a temporary one of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _OWN
    if _OWN is None:
        _OWN = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN


_OWN: str | None = None
_ROOTS: list[str] = []


class Stages:
    """Tables written in the shared folder: they cut lineage and survive lost executors. Those that no result reads are dropped by their
    operator as soon as the next one is written; those behind a result go with clear(), once the result has been written."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def clear(spark: SparkSession) -> int:
    """Deletes the stage tables of all operators that this process has run; results that aren't written yet can't be read any more."""
    n = len(_ROOTS)
    while _ROOTS:
        _delete(spark, _ROOTS.pop())
    return n
