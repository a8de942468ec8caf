"""Tables in the folder that all executors share, by which loops cut their lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder, which only a local master can share."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the executors of {master} share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='stridegraph-')}")
    return jsc.getCheckpointDir().get()


def _drop(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path in list(_written):
        try:
            _drop(path)
        except Exception:  # noqa: BLE001  the JVM has gone; the folder stays
            return


class Scratch:
    """keep() writes a table and reads it back; the tables stay until release() or the end of the process."""

    def __init__(self, spark: SparkSession, label: str = "table") -> None:
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", 0
        _written[self.root] = spark

    def keep(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, name: str, df: DataFrame) -> None:
        """More rows for a table that read() reads as one."""
        df.write.mode("append").parquet(f"{self.root}/{name}")

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def release(self) -> None:
        _drop(self.root)
