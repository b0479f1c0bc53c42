"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: iterations keep no lineage, and lost executors cost nothing."""
    return Scratch(df.sparkSession).staged(df, tag)


class Scratch:
    """Tables of one job in the shared folder, which can be deleted once what was made of them is itself a table."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, {}, {}

    def staged(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/wayfold-{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = path, made
        return made

    def dealt(self, df: DataFrame, tag: str, *keys: str) -> DataFrame:
        """Staged in buckets by ``keys``: joins, windows and groups by these leave the rows where they lie, round after round."""
        path, name = f"{shared_dir(self.spark)}/wayfold-{tag}-{uuid.uuid4().hex}", f"wayfold_{tag}_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).format("parquet").saveAsTable(name)
        made = self.spark.table(name)
        self.paths[id(made)], self.names[path] = (path, made), name
        return made

    def drop(self, *tables: DataFrame, but: tuple[DataFrame, ...] = ()) -> None:
        """Deletes these tables, or all but those of ``but``. Nothing that reads them may still be to run."""
        gone = [id(t) for t in tables] if tables else [k for k in self.paths if k not in {id(t) for t in but}]
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for k in gone:
            path, _ = self.paths.pop(k)
            if path in self.names:
                self.spark.sql(f"DROP TABLE {self.names.pop(path)}")
            place = jvm.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
