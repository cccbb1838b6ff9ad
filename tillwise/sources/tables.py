"""Readers and writers that bring a caller's tables into the declared schemas."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def conform(
    df: DataFrame, schema: StructType, renames: Mapping[str, str] | None = None
) -> DataFrame:
    """Select ``schema`` out of ``df``.

    ``renames`` maps a dotted schema column to the dotted column that holds it in ``df``.
    Columns of the right type pass through untouched, so filters still reach the scan and
    unused nested leaves are still pruned.
    """
    renames = renames or {}

    def find(root: DataType, path: str) -> DataType:
        for part in path.split("."):
            names = {f.name.lower(): f.dataType for f in root.fields}
            if part.lower() not in names:
                raise ValueError(f"no column {path!r} in the input")
            root = names[part.lower()]
        return root

    def pick(path: str, kind: DataType) -> Column:
        source = renames.get(path, path)
        if isinstance(kind, StructType) and path not in renames:
            return F.struct(
                *[pick(f"{path}.{f.name}", f.dataType).alias(f.name) for f in kind.fields]
            )
        held = find(df.schema, source)
        return F.col(source) if held == kind else F.col(source).cast(kind)

    return df.select(*[pick(f.name, f.dataType).alias(f.name) for f in schema.fields])


def read_parquet(
    spark: SparkSession, path: str, schema: StructType, renames: Mapping[str, str] | None = None
) -> DataFrame:
    return conform(spark.read.parquet(path), schema, renames)


def read_catalog(
    spark: SparkSession, name: str, schema: StructType, renames: Mapping[str, str] | None = None
) -> DataFrame:
    return conform(spark.table(name), schema, renames)


def read_csv(
    spark: SparkSession, path: str, schema: StructType, renames: Mapping[str, str] | None = None
) -> DataFrame:
    """CSV with a header row: columns are found by name, read as text and cast, not inferred."""
    return conform(spark.read.csv(path, header=True), schema, renames)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a table; partition facts by month to let date windows skip whole folders.

    The rows of a partition are gathered into few files, and a partition too large for one task
    is split again.
    """
    writer = df.hint("rebalance", partition_by) if partition_by else df
    writer = writer.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str, values: Iterable[str]) -> None:
    """Replace the partitions ``values`` of the table at ``path`` by the rows of ``df``.

    Other partitions stay as they are; rows of other values are not written.  A named partition
    without rows is removed.  The rows of a partition are gathered into few files.
    """
    values = sorted(set(values))
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = [jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}") for value in values]

    def held(folder) -> set[str]:
        system = folder.getFileSystem(conf)
        return {f.getPath().getName() for f in system.listStatus(folder)} if system.exists(folder) else set()

    before = [held(f) for f in folders]
    writer = df.filter(F.col(by).isin(values)).hint("rebalance", by).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    # Spark replaces only partitions that have rows; each write names its files anew.
    for folder, files in zip(folders, before):
        if files and held(folder) == files:
            folder.getFileSystem(conf).delete(folder, True)


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store ``df`` as catalog table ``name`` at ``path``, hashed by ``key`` into buckets.

    Tables of the same number of buckets are joined on their keys without moving either.  Rows
    are dealt to the buckets before they are written, so each bucket is one sorted file.
    """
    writer = df.repartition(buckets, key).write.mode("errorifexists").format("parquet")
    writer.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_catalog(df: DataFrame, name: str, path: str) -> None:
    """Store ``df`` as catalog table ``name`` with its files at ``path``."""
    df.write.mode("errorifexists").format("parquet").option("path", path).saveAsTable(name)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)
