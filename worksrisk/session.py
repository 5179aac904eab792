"""Where intermediate results are stored so that later steps need not recompute them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def storage_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without: it gets a folder of its own. On a cluster
    such a folder would not be shared, so the setting is required there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="worksrisk-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once to reliable storage and read from there.

    They are Parquet, so they take a fraction of a checkpoint's space and later steps read only
    the columns they need. Rows that Parquet cannot hold are checkpointed.
    """
    folder = storage_folder(df.sparkSession)
    kinds = df.schema.simpleString()
    if "void" in kinds or "interval" in kinds or len({c.lower() for c in df.columns}) < max(1, len(df.columns)):
        return df.checkpoint()
    path = f"{folder.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_buckets(df: DataFrame, column: str) -> DataFrame:
    """The same rows, stored in as many buckets of a column as there are shuffle partitions.

    Windows, sums and joins by that column need no shuffle of what is read from there.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions", "200")), f"stored_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("path", f"{storage_folder(spark).rstrip('/')}/{name}")
     .option("compression", "zstd").bucketBy(n, column).sortBy(column).saveAsTable(name))
    return spark.table(name)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own intermediate files, wherever it is stored."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Staging:
    """Intermediate Parquet tables in a new folder below the shared one.

    A staged table cuts the lineage as a checkpoint does, but keeps column pruning and can
    be dropped as soon as nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{storage_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write the rows once and read them back; ``name`` must be new in this folder."""
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))
