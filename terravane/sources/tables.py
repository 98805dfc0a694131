"""Site registry and training tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.operators.sampling import FEATURES

_SPAN = T.StructType([T.StructField("start", T.DateType()), T.StructField("end", T.DateType())])
REGISTRY_SCHEMA = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("bbox", T.StructType([T.StructField(k, T.DoubleType()) for k in ("west", "south", "east", "north")])),
    T.StructField("category", T.StringType()),
    T.StructField("label_type", T.StringType()),
    T.StructField("pre_event", _SPAN),
    T.StructField("post_event", _SPAN),
    T.StructField("description", T.StringType()),
])
REQUIRED = ("label", "row", "col")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sites from JSON lines: name, box, category (landslide, flood or safe), kind
    of label, date ranges and description."""
    return spark.read.schema(REGISTRY_SCHEMA).json(path)


def by_category(registry: DataFrame, category: str) -> DataFrame:
    return registry.filter(F.lower("category") == category.lower())


def site_bbox(registry: DataFrame, site: str) -> tuple[float, float, float, float]:
    """Box of one site; an unknown name is an error."""
    row = registry.filter(F.col("site") == site).select("bbox.*").head()
    if row is None:
        raise KeyError(f"site {site!r} is not in the registry")
    return tuple(row)


def training_schema(features: Sequence[str] = tuple(FEATURES)) -> T.StructType:
    fields = [T.StructField(k, T.IntegerType()) for k in ("row", "col", "label")]
    fields += [T.StructField(f, T.DoubleType()) for f in features]
    fields += [T.StructField("site", T.StringType()), T.StructField("site_id", T.IntegerType())]
    return T.StructType(fields)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Training CSV with a header; columns are typed by name, and label, row and
    col are required."""
    known = {f.name: f.dataType for f in training_schema().fields}
    names = spark.read.option("header", True).csv(path).columns  # header line only
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"training table lacks columns {missing}")
    schema = T.StructType([T.StructField(n, known.get(n, T.DoubleType())) for n in names])
    return spark.read.schema(schema).option("header", True).csv(path)


def write_training(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label")
