"""Reading and writing microdata tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from hearthstat.operators.prep import upper_names


def read_table(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: StructType | None = None,
    fmt: str = "parquet",
    normalise: bool = True,
    **options,
) -> DataFrame:
    """One table from one or several files of the same schema, e.g. one file per implicate.

    A text format needs a schema: inferring one costs a scan of the data.
    """
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"reading {fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load([paths] if isinstance(paths, str) else list(paths))
    return upper_names(df) if normalise else df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet sink; partition by country or implicate where later reads filter on it."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header and `NA` for missing values; one part file per task."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)
