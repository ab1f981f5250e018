"""Reading exports: explicit schemas, mixed files of a folder, file inventory."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed


def export_schema(source: str) -> T.StructType:
    """All export columns are text except the numeric id."""
    return T.StructType([
        T.StructField(c, T.LongType() if c == "id" else T.StringType()) for c in fixed.RAW_COLUMNS[source]
    ])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a declared schema; nothing is inferred, so the files are read once."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_pattern(spark: SparkSession, folder: str, patterns: dict[str, str]) -> DataFrame:
    """Files of several sources chosen by name pattern, as one frame with a `source` column."""
    parts = [
        read_csv(spark, f"{folder}/{pattern}", export_schema(source)).withColumn("source", F.lit(source))
        for source, pattern in patterns.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def inventory(df: DataFrame) -> DataFrame:
    """Files behind a scan with their size and row count."""
    return df.groupBy(
        F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size")
    ).agg(F.count("*").alias("rows"))
