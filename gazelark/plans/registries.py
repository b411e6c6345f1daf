"""The registries that a user works with: lookups that return DataFrames, rows only at the edge."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, compound, join_bar, split_bar
from ..operators import fts, fuzzy, hierarchy, lookup
from ..sources import readers, tables
from ..spec import CITIES, COUNTRIES, SUBDIVISIONS, EntitySpec


class Registry:
    """A table with its index. Stored columns stay texts, as files have them; records() types them."""

    spec: EntitySpec

    def __init__(self, df: DataFrame | None = None, ordered_by: str | None = None):
        self._df = self._index = self._count = None
        if df is not None:
            self.register(df, ordered_by)

    def register(self, df: DataFrame, ordered_by: str | None = None) -> None:
        """Take a table; one without ids gets them in the order of a column, or in that of its file."""
        if self.spec.key not in df.columns:
            if ordered_by is None:
                df, ordered_by = df.withColumn("_line", F.monotonically_increasing_id()), "_line"
            df = lookup.with_ids(df, ordered_by, key=self.spec.key).drop("_line")
        self._df, self._index, self._count = df.cache(), None, None

    def unregister(self) -> None:
        if self._df is not None:
            self._df.unpersist()
        self._df = self._index = self._count = None

    def store(self, path: str) -> None:
        """Write the table and its index, each replaced as a whole; open() reads them without building anything."""
        fresh = f"{path}/index.fresh"
        tables.replace_atomically(self.table, f"{path}/table")
        fts.TextIndex.build(self.table, self.spec).write(fresh)
        tables.remove(self.table.sparkSession, f"{path}/index")
        tables.relocate(self.table.sparkSession, fresh, f"{path}/index")

    def open(self, spark: SparkSession, path: str) -> None:
        """Take what store() has written."""
        self._df, self._count = spark.read.parquet(f"{path}/table"), None
        self._index = fts.TextIndex.read(spark, f"{path}/index", self.spec)

    @property
    def table(self) -> DataFrame:
        if self._df is None:
            raise RuntimeError(f"{self.spec.name} aren't loaded; register() a table first")
        return self._df

    @property
    def index(self) -> fts.TextIndex:
        if self._index is None:
            self._index = fts.TextIndex.build(self.table, self.spec).cached()
        return self._index

    @property
    def count(self) -> int:
        if self._count is None:
            self._count = self.table.count()
        return self._count

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[Row]:
        return lookup.rows(self.records(), self.spec)

    def __getitem__(self, at: int | slice) -> Row | list[Row]:
        if isinstance(at, slice):
            return lookup.sliced(self.records(), self.spec, at.start, at.stop, at.step).collect()
        return lookup.at(self.records(), self.spec, at)

    def get(self, **keys) -> DataFrame:
        return lookup.get(self.table, self.spec, **keys)

    def filter(self, query: str | None = None, limit: int | None = None, **given) -> DataFrame:
        return fts.filtered(self.table, self.index, query, limit, **given)

    def search(self, query: str | DataFrame, limit: int | None = None) -> DataFrame:
        """Typo-tolerant matches of a text, or of each text of a table (qid, query)."""
        table = self.table
        if isinstance(query, DataFrame):
            return fuzzy.search(query, table, self.index, limit)
        if query and not query.split():
            raise ValueError("a query of white space only")
        queries = table.sparkSession.createDataFrame([(0, query or "")], "qid int, query string")
        return fuzzy.search(queries, table, self.index, limit).drop("qid")

    def records(self, df: DataFrame | None = None) -> DataFrame:
        return self.table if df is None else df


class Countries(Registry):
    spec = COUNTRIES

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Countries:
        return cls(readers.tsv(spark, path, readers.COUNTRY_COLUMNS))

    def records(self, df: DataFrame | None = None) -> DataFrame:
        df = self.table if df is None else df
        return df.withColumns({"numeric": F.col("numeric").cast("int"), "alt_names": split_bar("alt_names")}).drop("rank")


class Subdivisions(Registry):
    spec = SUBDIVISIONS

    def __init__(self, df: DataFrame | None = None, countries: Countries | None = None):
        super().__init__(df)
        self.countries = countries

    def for_country(self, admin_level: int | None = 1, **keys) -> DataFrame:
        return hierarchy.for_country(self.countries.table, COUNTRIES, self.table, level=admin_level, **keys)

    def types_for_country(self, admin_level: int | None = 1, **keys) -> DataFrame:
        return hierarchy.types_for_country(self.countries.table, COUNTRIES, self.table, level=admin_level, **keys)

    def records(self, df: DataFrame | None = None) -> DataFrame:
        df = self.table if df is None else df
        return df.withColumns({"alt_names": split_bar("alt_names"), "admin_level": hierarchy.admin_level(), "parent_id": F.col("parent_id").cast("bigint"), "country": compound("country", ("name", "alpha2", "alpha3"), strict=True)}).drop("rank")


class Cities(Registry):
    spec = CITIES

    def __init__(self, df: DataFrame | None = None, countries: Countries | None = None, subdivisions: Subdivisions | None = None):
        super().__init__(df)
        self.countries, self.subdivisions = countries, subdivisions

    def load(self, spark: SparkSession, path: str) -> None:
        raw = readers.tsv(spark, path, readers.CITY_COLUMNS)
        self.register(raw.withColumn("population", F.col("population").cast("bigint")))

    def for_country(self, population__gt: int | None = None, population__lt: int | None = None, **keys) -> DataFrame:
        return hierarchy.for_country(self.countries.table, COUNTRIES, self.table, range_column="population", above=population__gt, below=population__lt, **keys)

    def for_subdivision(self, population__gt: int | None = None, population__lt: int | None = None, **keys) -> DataFrame:
        parents = lookup.get(self.subdivisions.table, SUBDIVISIONS, **keys)
        return hierarchy.for_subdivision(parents, join_bar("name", "geonames_code", "iso_code"), self.table, "admin1", "admin2", "population", population__gt, population__lt)

    def records(self, df: DataFrame | None = None) -> DataFrame:
        df = self.table if df is None else df
        return df.select(*[c for c in df.columns if c not in ("admin1", "admin2", "country", "alt_names", "geonames_id", "population", "lat", "lng", "rank")], *city_fields())


def display_name(name: str = "name", country: Column | None = None) -> Column:
    """The name, the subdivisions that it has from the lower up, and the country, blank if none."""
    parts = [F.col(name), clean(F.split_part("admin2", F.lit("|"), F.lit(1))), clean(F.split_part("admin1", F.lit("|"), F.lit(1))), country if country is not None else F.coalesce(F.split_part("country", F.lit("|"), F.lit(1)), F.lit(""))]
    return F.concat_ws(", ", *parts)


def city_fields() -> list[Column]:
    def level(c: str, n: int) -> Column:
        return F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(*[compound(c, ("name", "geonames_code", "iso_code"))[x].alias(x) for x in ("name", "geonames_code", "iso_code")], F.lit(n).alias("admin_level")))

    return [
        F.col("geonames_id").cast("bigint").alias("geonames_id"),
        display_name().alias("display_name"),
        F.array_compact(F.array(level("admin1", 1), level("admin2", 2))).alias("subdivisions"),
        compound("country", ("name", "alpha2", "alpha3")).alias("country"),
        F.col("population").cast("bigint").alias("population"),
        F.col("lat").cast("double").alias("lat"),
        F.col("lng").cast("double").alias("lng"),
        split_bar("alt_names").alias("alt_names"),
    ]
