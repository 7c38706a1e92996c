"""Reading the input tables."""
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (any file system Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
