"""Children of a parent, with ranges and distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_bar
from ..spec import EntitySpec
from .lookup import get


def admin_level(parent: str = "parent_id") -> Column:
    return F.when(F.col(parent).isNotNull() & (F.col(parent).cast("string") != ""), 2).otherwise(1)


def in_range(column: str, above: float | None = None, below: float | None = None) -> Column:
    """Strictly above or strictly below; not both."""
    if above is not None and below is not None:
        raise ValueError("above and below can't be combined")
    if above is not None:
        return F.col(column) > above
    return F.col(column) < below if below is not None else F.lit(True)


def children(parents: DataFrame, parent_key: Column, df: DataFrame, field: str) -> DataFrame:
    """Rows of df whose field is the key of one of the parents."""
    return df.join(parents.select(parent_key.alias("_parent")).distinct(), F.col(field) == F.col("_parent"), "left_semi")


def for_country(countries: DataFrame, spec: EntitySpec, df: DataFrame, field: str = "country", level: int | None = None, range_column: str | None = None, above: float | None = None, below: float | None = None, **keys) -> DataFrame:
    """Rows of the country that the keys give; none if they give none."""
    out = children(get(countries, spec, **keys), join_bar("name", "alpha2", "alpha3"), df, field)
    out = out.where(admin_level() == level) if level is not None else out
    return out.where(in_range(range_column, above, below)) if range_column else out


def types_for_country(countries: DataFrame, spec: EntitySpec, df: DataFrame, level: int | None = 1, **keys) -> DataFrame:
    """Different types, sorted. A level of None matches no row's level, so it gives none."""
    rows = for_country(countries, spec, df, level=level, **keys)
    rows = rows.limit(0) if level is None else rows
    return rows.where(F.col("type").isNotNull() & (F.col("type") != "")).select("type").distinct().orderBy("type")


def for_subdivision(parents: DataFrame, parent_key: Column, df: DataFrame, first: str, second: str, range_column: str | None = None, above: float | None = None, below: float | None = None) -> DataFrame:
    """Rows under each parent by the first field; for a parent with none in the range there, by the second field, in the range.

    A range end of 0 isn't asked for in the first look, only afterwards, so rows outside it keep the second field from being tried.
    """
    keyed = parents.select(parent_key.alias("_parent")).distinct()
    pushed = in_range(range_column, above or None, below or None) if range_column else F.lit(True)
    after = in_range(range_column, above, below) if range_column else F.lit(True)
    direct = df.where(pushed).join(keyed, F.col(first) == F.col("_parent"))
    left = keyed.join(direct.select("_parent").distinct(), "_parent", "left_anti")
    deeper = df.join(left, F.col(second) == F.col("_parent"))
    return direct.unionByName(deeper).where(after).drop("_parent")


def with_parents(df: DataFrame, key: str = "id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """Each row with its parent's name, null for the top."""
    up = df.select(F.col(key).cast("string").alias("_up"), F.col(name).alias("parent_name"))
    return df.join(up, F.col(parent).cast("string") == F.col("_up"), "left").drop("_up")
