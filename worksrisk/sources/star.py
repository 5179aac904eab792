"""Reading and writing the star schema, the duplicate scores and the vector index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worksrisk import schemas as S
from worksrisk.functions.cells import normalise_missing
from worksrisk.session import stored

# fixed values: how the tables are partitioned on disk
PARTITION_BY = {"works_master": ["State"]}
LOOKED_UP = {"works_master": "Work_ID", "compliance_and_ml": "Work_ID"}


@dataclass(frozen=True)
class Star:
    """The five tables every feature, score and listing starts from."""

    works: DataFrame
    members: DataFrame
    vendors: DataFrame
    geography: DataFrame
    compliance: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(zip(S.STAR, (self.works, self.members, self.vendors, self.geography,
                                 self.compliance)))


def in_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns that are present, in declared order and type."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name)
                      for f in schema.fields if f.name in df.columns])


def _csv_schema(schema: T.StructType) -> T.StructType:
    """Counts may be written as '7.0' beside gaps, so they are read as double first."""
    whole = (T.IntegerType, T.LongType)
    return T.StructType([T.StructField(f.name, T.DoubleType() if isinstance(f.dataType, whole)
                                       else f.dataType) for f in schema.fields])


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
               columns: list[str] | None = None, *, multi_line: bool = True) -> DataFrame:
    """A stored table with its declared types and missing-value texts as null.

    CSV cells may hold line breaks; ``multi_line=False`` for files without any lets Spark
    split them.
    """
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        present = T.StructType([f for n in header for f in _csv_schema(schema).fields
                                if f.name == n])
        df = (spark.read.schema(present).option("header", True).option("escape", '"')
              .option("multiLine", multi_line).csv(path))
        df = in_schema(normalise_missing(df), schema)
    else:
        df = spark.read.schema(schema).format(fmt).load(path)
    return df.select(columns) if columns else df


def read_star(spark: SparkSession, folder: str, fmt: str = "parquet", *,
              multi_line: bool = True) -> Star:
    return Star(*(read_table(spark, _path(folder, name, fmt), schema, fmt, multi_line=multi_line)
                  for name, schema in S.STAR.items()))


def _path(folder: str, name: str, fmt: str) -> str:
    return f"{folder}/{name}.csv" if fmt == "csv" else f"{folder}/{name}"


def write_star(star: Star, folder: str, fmt: str = "parquet", mode: str = "errorifexists", *,
               compression: str | None = None) -> None:
    """Store the five tables; CSV is plain unless ``compression`` names a codec, such as gzip.

    In Parquet, tables with a row per work are sorted by their key inside each file and carry
    Bloom filters of it, so a look-up of one work skips the row groups that cannot hold it.
    Works are not shuffled for it: a task writes one file for each state it has, and a folder
    with most of the rows still has many writers.
    """
    for name, df in star.tables().items():
        out, by = in_schema(df, S.STAR[name]), PARTITION_BY.get(name, [])
        if fmt == "csv":
            writer = (out.write.option("header", True).option("escape", '"')
                      .option("compression", compression or "none")
                      .option("zlib.compress.level", "BEST_SPEED"))
        else:
            key = LOOKED_UP.get(name)
            out = out.sortWithinPartitions(*by, key) if key else out
            writer = out.write.partitionBy(*by).option("compression", compression or "zstd")
            if key:
                writer = (writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
                          .option("parquet.bloom.filter.adaptive.enabled", "true"))
        writer.mode(mode).format(fmt).save(_path(folder, name, fmt))


def write_duplicates(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    in_schema(scores, S.DUPLICATES).write.mode(mode).parquet(path)


def read_duplicates(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored duplicate scores, or None (every score then counts as 0)."""
    try:
        return spark.read.schema(S.DUPLICATES).parquet(path)
    except AnalysisException:
        return None


def write_index(vectors: DataFrame, path: str, model_name: str,
                mode: str = "errorifexists") -> None:
    """Vectors clustered by block, so that a block's rows sit in few row groups.

    ``model_name`` tells the model that made them; vectors are arrays of numbers, or terms
    and weights. They are stored first: cutting blocks into ranges reads them once more, and the model
    should not run twice.
    """
    dense = isinstance(vectors.schema["embedding"].dataType, T.ArrayType)
    out = vectors.select(
        F.lit(model_name).alias("model_name"), F.col("Work_ID").alias("work_id"),
        F.col("Vendor_Name").alias("vendor_name"), F.col("Constituency").alias("constituency"),
        F.col("embedding").cast(T.ArrayType(T.FloatType())) if dense else F.col("embedding"))
    (stored(out).repartitionByRange("vendor_name", "constituency", "work_id")
     .sortWithinPartitions("vendor_name", "constituency")
     .write.mode(mode).parquet(path))


def read_index(spark: SparkSession, path: str, model_name: str | None = None) -> DataFrame | None:
    """Stored vectors, or None. They must have been made by ``model_name``, if it is given.

    Vectors of another model mean something else, so their similarities would be noise.
    """
    try:
        index = spark.read.parquet(path)
    except AnalysisException:
        return None
    if model_name is not None:
        other = index.select("model_name").filter(~F.col("model_name").eqNullSafe(model_name)).first()
        if other is not None:
            raise ValueError(f"the index holds vectors of {other[0]!r}, not of {model_name!r}")
    return index
