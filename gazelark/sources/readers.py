"""Reading entity tables and raw dumps; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean

# The column names of the files.
COUNTRY_COLUMNS = ("name", "official_name", "alpha2", "alpha3", "numeric", "alt_names", "flag")
SUBDIVISION_COLUMNS = ("id", "name", "alt_names", "geonames_code", "iso_code", "country", "type", "parent_id")
CITY_COLUMNS = ("geonames_id", "name", "alt_names", "admin1", "admin2", "country", "population", "lat", "lng")
GEONAMES_COLUMNS = (
    "geonameid", "name", "asciiname", "alternatenames", "latitude", "longitude", "feature class", "feature code", "country code", "cc2",
    "admin1 code", "admin2 code", "admin3 code", "admin4 code", "population", "elevation", "dem", "timezone", "modification date",
)


def _schema(columns: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def tsv(spark: SparkSession, path: str, columns: tuple[str, ...], header: bool = True, quoted: bool = True) -> DataFrame:
    """Tab-separated texts with the given columns; blank ones are null. A header must name the same columns."""
    reader = spark.read.option("sep", "\t").option("header", header).option("enforceSchema", False).option("quote", '"' if quoted else "").option("escape", '"').option("mode", "FAILFAST")
    df = reader.schema(_schema(columns)).csv(path)
    return df.select(*[clean(f"`{c}`").alias(c) for c in columns])


def csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').schema(_schema(columns)).csv(path)


def lines(spark: SparkSession, path: str, **places: int) -> DataFrame:
    """Tab-separated lines without quoting: name=position."""
    parts = F.split(F.trim("value"), "\t", -1)
    return spark.read.text(path).select(*[F.get(parts, at).alias(name) for name, at in places.items()])


def json_records(spark: SparkSession, path: str, schema: str, root: str | None = None) -> DataFrame:
    """Records of a JSON array, or of the array under a key of the file's one object."""
    if root is None:
        return spark.read.schema(schema).json(path, multiLine=True)
    whole = spark.read.schema(T.StructType([T.StructField(root, T.ArrayType(T.StructType.fromDDL(schema)))])).json(path, multiLine=True)
    return whole.select(F.explode(f"`{root}`").alias("r")).select("r.*")


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a JSON object of objects of the given type."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def lookup_table(df: DataFrame, key: str, value, order: str) -> DataFrame:
    """(key, value), the last row of a key by order counting."""
    return df.groupBy(F.col(key).alias("key")).agg(F.max_by(value, F.col(order)).alias("value"))
