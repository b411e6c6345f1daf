"""Longest common subsequences against the plain table, and how many tasks work on a file of one row group."""

import random

import pytest
from pyspark.sql import functions as F

from gazelark.functions.similarity import common_subsequence
from gazelark.session import spread


def plain(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, d in enumerate(b):
            before, row[j + 1] = row[j + 1], max(row[j + 1], row[j], before + (c == d))
    return row[-1]


def test_common_subsequence_of_texts_with_common_ends(spark):
    rng = random.Random(4)
    drawn = lambda n: "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, n)))
    pairs = [(h + drawn(5) + t, h + drawn(5) + t) for h, t in ((drawn(9), drawn(9)) for _ in range(150))]
    pairs += [(drawn(150), drawn(150)) for _ in range(20)] + [("a" * 70, "a" * 64), ("ab" * 40, "ba" * 40), ("", "x"), ("x", ""), ("", ""), ("x", "x"), ("abab", "ab")]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: plain(a, b) for i, (a, b) in enumerate(pairs)}


def test_a_file_of_one_row_group_is_worked_on_by_many_tasks(spark, tmp_path):
    pytest.importorskip("pyarrow")
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"p_partkey": list(range(5000)), "p_name": ["red widget"] * 5000}), str(tmp_path / "part.parquet"))
    from gazelark.plans import build_catalogue

    plan = build_catalogue.typo_injection(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p_partkey" in plan
    rows = spread(spark.read.parquet(str(tmp_path / "part.parquet")), "p_partkey")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_citys_names_are_decomposed_once_each(spark):
    """A lambda works out what stands in it for each value, so what is long is named once."""
    from gazelark.plans.etl import city_aliases

    assert str(city_aliases(F.col("name"), F.col("alternatenames"), F.col("asciiname"))).count("translate(") == 2


def test_an_index_splits_a_frequent_token_and_reads_as_built(spark, tmp_path):
    from gazelark.operators import fts
    from gazelark.spec import EntitySpec

    built = fts.TextIndex.build(spark.range(5000).select("id", F.lit("la été").alias("name")), EntitySpec("t", ("name",)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be read by one task
    built.write(str(tmp_path / "index"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = fts.TextIndex.read(spark, str(tmp_path / "index"), built.spec)
    assert sorted(map(tuple, read.postings.collect())) == sorted(map(tuple, built.postings.collect())) and read.totals() == (5000, 2.0)
    assert read.postings.where("token = 'la'").select(F.input_file_name().alias("f")).distinct().count() > 1
    assert not (tmp_path / "index" / "found").exists()
