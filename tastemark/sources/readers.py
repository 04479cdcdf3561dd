"""Typed scans of review, business and user dumps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REVIEW = T.StructType([
    T.StructField("review_id", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("business_id", T.StringType()),
    T.StructField("stars", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("date", T.DateType()),
    T.StructField("useful", T.IntegerType()), T.StructField("funny", T.IntegerType()), T.StructField("cool", T.IntegerType()),
])
BUSINESS = T.StructType([
    T.StructField("business_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("address", T.StringType()),
    T.StructField("city", T.StringType()), T.StructField("state", T.StringType()), T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()), T.StructField("stars", T.DoubleType()), T.StructField("review_count", T.IntegerType()),
    T.StructField("is_open", T.IntegerType()), T.StructField("categories", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("hours", T.MapType(T.StringType(), T.StringType())),
])
USER = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("average_stars", T.DoubleType())])

REVIEW_NAMES = {"stars": "review_stars", "text": "review_text", "cool": "review_cool", "funny": "review_funny", "useful": "review_useful"}
BUSINESS_NAMES = {"stars": "business_stars", "rating": "business_stars"}
BAD_LINE = "_bad_line"


def json_lines(spark: SparkSession, path: str, schema: T.StructType, keep_bad: bool = False) -> DataFrame:
    """One JSON object per line. Unreadable lines drop out, or stay in ``_bad_line``."""
    if keep_bad:
        full = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
        return spark.read.schema(full).option("columnNameOfCorruptRecord", BAD_LINE).json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that each hold one JSON array of records. Such a file is one task; convert it to parquet once."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with header and doubled quotes; only ``columns`` are parsed.

    ``multi_line`` allows quoted line breaks, but makes each file one task: convert such files to parquet once.
    """
    df = spark.read.schema(schema).csv(path, header=True, multiLine=multi_line, escape='"')
    return df.select(*columns) if columns else df


def normalise_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename to the names the operators use."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return normalise_columns(json_lines(spark, path, REVIEW), REVIEW_NAMES)


def read_business(spark: SparkSession, path: str) -> DataFrame:
    return normalise_columns(json_lines(spark, path, BUSINESS), BUSINESS_NAMES)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, USER)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
