"""CSV, JSON log, array and metadata files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.scalars import FILE_NA_TOKENS


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = ",",
    header: bool = True,
    na_tokens=FILE_NA_TOKENS,
) -> DataFrame:
    """CSV scan with a declared schema; every NA spelling becomes null.

    Without header the columns are named col_0, col_1, ..
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).csv(path, sep=sep, header=header, quote='"', escape='"')
    out = []
    for i, f in enumerate(schema):
        value = F.when(~F.trim(F.col(f.name)).isin(*na_tokens), F.col(f.name))
        typed = value if isinstance(f.dataType, T.StringType) else value.try_cast(f.dataType)
        out.append(typed.alias(f.name if header else f"col_{i}"))
    return raw.select(*out)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.csv(path, header=True, sep=sep, quote='"', escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss")


def read_json_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines log; a log that was never written is empty."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_json_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """Feature matrix plus labels: one parquet row per sample."""
    df.write.parquet(path)


def read_arrays(spark: SparkSession, path: str, array: str, key: str, label: str) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField(key, T.LongType()),
            T.StructField(array, T.ArrayType(T.FloatType())),
            T.StructField(label, T.IntegerType()),
        ]
    )
    return spark.read.schema(schema).parquet(path)


def dataset_metadata(df: DataFrame, label: str, n_features: int) -> DataFrame:
    """One row: size, class rates and balanced class weights of a binary data set."""
    pos = F.count_if(F.col(label) == 1)
    n = F.count("*")
    return df.agg(
        n.alias("n_rows"),
        F.lit(n_features).alias("n_features"),
        pos.alias("n_positive"),
        (pos / n).alias("positive_rate"),
        F.try_divide(n, 2.0 * pos).alias("weight_positive"),
        F.try_divide(n, 2.0 * (n - pos)).alias("weight_negative"),
    )
