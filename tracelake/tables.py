"""Tables of an iteration, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a local session names none, a local folder. Makes checkpoint() use it too."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-tracelake-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Tables:
    """Named tables: writing one anew cuts its lineage and frees the one before it.

    What is left is freed when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        self.files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Writes df as this name's table and reads it back; df may be computed from the one before."""
        path = self.files(f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        system.deleteOnExit(path)
        df.write.parquet(path.toString())
        self.free(name)
        self.paths[name] = (system, path)
        return self.spark.read.schema(df.schema).parquet(path.toString())

    def free(self, *names: str) -> None:
        """Removes tables; nothing may read them any more."""
        for name in names:
            if name in self.paths:
                system, path = self.paths.pop(name)
                system.delete(path, True)
