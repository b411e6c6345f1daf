"""Writing tables, key-value stores, and the load and unload of a registry's data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def create(spark: SparkSession, name: str, schema: str, path: str | None = None) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet" + (f" LOCATION '{path}'" if path else ""))


def create_many(spark: SparkSession, tables: dict[str, str]) -> None:
    for name, schema in tables.items():
        create(spark, name, schema)


def drop(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def insert(df: DataFrame, name: str) -> None:
    """Append by column name; columns that the table lacks are refused."""
    extra = set(df.columns) - set(df.sparkSession.table(name).columns)
    if extra:
        raise ValueError(f"{name} has no {sorted(extra)}")
    df.write.mode("append").saveAsTable(name)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def replace_atomically(df: DataFrame, path: str) -> None:
    """Write beside the table and swap when all is there; an error leaves the old table."""
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    fresh, old = jvm.Path(f"{path}.fresh"), jvm.Path(f"{path}.old")
    fs = fresh.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fresh, True)
    df.write.parquet(f"{path}.fresh")
    fs.delete(old, True)
    if fs.exists(jvm.Path(path)):
        fs.rename(jvm.Path(path), old)
    fs.rename(fresh, jvm.Path(path))
    fs.delete(old, True)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def relocate(spark: SparkSession, path: str, to: str) -> None:
    """Move a stored table. What is at the new place already is refused; between stores the files are copied and then removed."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    old, new = hadoop.Path(path), hadoop.Path(to)
    if exists(spark, to):
        raise FileExistsError(to)
    from_store, to_store = old.getFileSystem(conf), new.getFileSystem(conf)
    to_store.mkdirs(new.getParent())
    if not hadoop.FileUtil.copy(from_store, old, to_store, new, True, conf):
        raise OSError(f"{path} wasn't moved to {to}")


def write_tsv(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """One tab-separated file with a header, columns in the given order."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON, with nulls."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_json_object(df: DataFrame, path: str, key: str) -> None:
    """One indented JSON object of a small table: each row's other columns by its key, in order. A key that repeats is an error."""
    entry = F.struct(F.col(key).cast("string").alias("key"), F.struct(*[c for c in df.columns if c != key]).alias("value"))
    whole = df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry))), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    whole.write.mode("overwrite").text(path)


def upserted(store: DataFrame, changes: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The store with changes: for each key the row of the greatest order; store rows have order 0 at least."""
    every = store.unionByName(changes)
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    return every.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def flags_reset(store: DataFrame) -> DataFrame:
    """Flags of 1 back at 0."""
    return store.withColumn("value", F.when(F.col("value") == "1", "0").otherwise(F.col("value")))
