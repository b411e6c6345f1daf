"""Predicates, exact gets, scans and slices."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import like, py_tokens
from ..session import scratch
from ..spec import EntitySpec


def equals(spec: EntitySpec, field: str, value) -> Column:
    """Exact, case-sensitive and on the whole value. Columns that aren't indexed and values without a token match nothing."""
    if field in spec.stored or not py_tokens(str(value)):
        return F.lit(False)
    return F.col(field).cast("string") == F.lit(str(value))


def differs(field: str, value) -> Column:
    return F.col(field).cast("string") != F.lit(str(value))


def compared(field: str, sign: str, value, numeric: bool = False) -> Column:
    """< <= > >= on the texts, as the table stores them; numeric compares numbers."""
    left, right = (F.col(field), F.lit(value)) if numeric else (F.col(field).cast("string"), F.lit(str(value)))
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[sign]


def is_like(field: str, pattern: str) -> Column:
    return like(F.col(field).cast("string"), pattern)


def is_in(field: str, values: list) -> Column:
    return F.col(field).cast("string").isin([str(v) for v in values])


def with_ids(df: DataFrame, *order: str, key: str = "id") -> DataFrame:
    """Ids from 1 in the given order. One range exchange sorts the rows; a row's number is its partition's offset and its place."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # the ranges come from a sample, so both uses below must see one and the same
    spark, path = df.sparkSession, scratch(df.sparkSession, "ranged")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_place", place).join(before, "_part").select((F.col("_before") + F.col("_place")).alias(key), *df.columns)


def scan(df: DataFrame, spec: EntitySpec) -> DataFrame:
    return df.orderBy(spec.key)


def select(df: DataFrame, where: Column | None = None, order_by: list[Column | str] = (), limit: int = 0) -> DataFrame:
    """limit 0: all."""
    out = df.where(where) if where is not None else df
    out = out.orderBy(*order_by) if order_by else out
    return out.limit(limit) if limit else out


def get(df: DataFrame, spec: EntitySpec, **keys) -> DataFrame:
    """The first row with the key, or none. Of several keys the last of spec.get_keys decides; unknown names count for nothing."""
    given = [k for k in spec.get_keys if keys.get(k) is not None]
    if not given:
        return df.limit(0)
    name = given[-1]
    match = get_by_id_match(spec, keys[name]) if name in ("id", spec.key) else equals(spec, name, keys[name])
    return df.where(match).orderBy(spec.key).limit(1)


def get_by_id_match(spec: EntitySpec, value) -> Column:
    """Ids match as numbers, given as a number or as text."""
    return F.col(spec.key) == F.lit(str(value)).try_cast("bigint")


def batch_get(keys: DataFrame, df: DataFrame, key: str, column: str) -> DataFrame:
    """One row a key that is there, the first by id where several match: an equi-join that Spark broadcasts only by size."""
    first = df.groupBy(F.col(column).alias("_key")).agg(F.min("id").alias("_first")) if "id" in df.columns and column != "id" else None
    if first is not None:
        df = df.join(first, (F.col(column) == F.col("_key")) & (F.col("id") == F.col("_first"))).drop("_key", "_first")
    return keys.join(df, F.col(key) == F.col(column))


def sliced(df: DataFrame, spec: EntitySpec, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    """Rows by place in id order, as a Python slice takes them."""
    total = df.count() if (start or 0) < 0 or (stop or 0) < 0 or (step or 1) < 0 else None
    if total is None and (step or 1) == 1:
        out = df.orderBy(spec.key)
        out = out.limit(stop) if stop is not None else out
        return out.offset(start) if start else out
    picked = range(*slice(start, stop, step).indices(df.count() if total is None else total))
    if not len(picked):
        return df.limit(0)
    numbered = with_ids(df, spec.key, key="_row").withColumn("_row", F.col("_row") - 1)
    low, high = min(picked[0], picked[-1]), max(picked[0], picked[-1])
    out = numbered.where(F.col("_row").between(low, high) & ((F.col("_row") - low) % abs(picked.step) == 0))
    return out.orderBy(F.col("_row").desc() if picked.step < 0 else F.col("_row")).drop("_row")


def at(df: DataFrame, spec: EntitySpec, index: int) -> Row:
    """The row at a place; a negative one counts from the end."""
    ordered = df.orderBy(F.col(spec.key).desc()).offset(-index - 1) if index < 0 else df.orderBy(spec.key).offset(index)
    row = ordered.first()
    if row is None:
        raise IndexError(index)
    return row


def rows(df: DataFrame, spec: EntitySpec) -> Iterator[Row]:
    """All rows in id order, a partition at a time."""
    return df.orderBy(spec.key).toLocalIterator()


def as_records(df: DataFrame, column: str = "record") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(column))
