"""Named queries of the typo-tolerant search over several weighted fields, and of its benchmark, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import typos
from ..operators import fuzzy
from ..spec import EntitySpec
from .catalogue import _query, _set_ratio_sql, named_parts, parts, stored_index, table, NAMES

#: Parts with an alias field of two values; ties of the score go by price.
GOODS = EntitySpec("goods", ("name", "alt_names", "brand"), stored=("price",), weights={"name": 1.0, "alt_names": 1.5, "brand": 0.4}, order_fields=("price",))
_GOODS = "(SELECT p_partkey AS id, p_name AS name, lower(p_type) || ' ' || p_name || '|' || lower(p_type) || ' stock' AS alt_names, p_brand AS brand, round(p_retailprice) AS price FROM part)"
ASKED = ("smal widget", "brand", "large stokc", "blue gaer", "zzzz", "economy gizmo")


def goods(spark, d) -> DataFrame:
    p = parts(spark, d)
    return p.select("id", "name", F.concat(F.lower("type"), F.lit(" "), F.col("name"), F.lit("|"), F.lower("type"), F.lit(" stock")).alias("alt_names"), "brand", F.round("price").alias("price"))


def _fields_sql(limit: int) -> str:
    values = ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED))
    weights = {"name": 1.0, "alt_names": 1.5, "brand": 0.4}
    parts_of = " UNION ALL ".join(f"SELECT id, '{f}' AS f, {w} AS weight, unnest(string_split(lower({f}), '|')) AS part FROM docs" for f, w in weights.items())
    return f"""
  WITH RECURSIVE q AS (SELECT * FROM (VALUES {values}) AS v(qid, query)),
  docs AS (SELECT * FROM {_GOODS}),
  qw AS (SELECT qid, query, unnest(string_split(query, ' ')) AS w, generate_subscripts(string_split(query, ' '), 1) AS no FROM q),
  lengths AS (SELECT qid, max(length(w)) AS rounds, count(*) AS words FROM qw GROUP BY qid),
  dw AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(name || ' ' || alt_names || ' ' || brand), '[a-z0-9]+')) AS t FROM docs),
  vocabulary AS (SELECT DISTINCT t FROM dw),
  met AS (
    SELECT qid, no, t, min(CASE WHEN w = t THEN 1 ELSE greatest(2, 1 + length(w) - list_max(list_filter(generate_series(0, length(w)), lambda k: starts_with(t, w[1:k])))) END) AS r
    FROM qw, vocabulary WHERE w[1:1] = t[1:1] GROUP BY qid, no, t),
  came AS (SELECT qid, no, id, min(r) AS r FROM met JOIN dw USING (t) GROUP BY qid, no, id),
  rows_ AS (SELECT qid, id, max(r) AS r FROM came JOIN lengths USING (qid) WHERE r <= rounds GROUP BY qid, id, words HAVING count(*) = words),
  field_parts AS ({parts_of}),
  asked_parts AS (SELECT DISTINCT q.qid, q.query, p.part FROM rows_ JOIN q USING (qid) JOIN field_parts p USING (id)),
  {_set_ratio_sql("SELECT DISTINCT query AS a, part AS b FROM asked_parts")},
  field_scores AS (SELECT rows_.qid, id, r, f, weight, max(ratio) / 100 AS s FROM rows_ JOIN q USING (qid) JOIN field_parts p USING (id) JOIN ratios ON a = query AND b = part GROUP BY ALL),
  scored AS (SELECT qid, id, r, coalesce(sum(s * weight) FILTER (s >= 0.6) / sum(weight) FILTER (s >= 0.6), 0) AS score FROM field_scores GROUP BY qid, id, r),
  stops AS (
    SELECT qid, rounds, 0 AS i, 0::BIGINT AS last, 0 AS stop FROM lengths
    UNION ALL
    SELECT s.qid, s.rounds, s.i + 1,
      (SELECT count(*) FROM scored x WHERE x.qid = s.qid AND x.r <= s.i + 1 AND score >= 0.6) - s.last,
      CASE WHEN s.i + 1 = s.rounds OR EXISTS (SELECT 1 FROM scored x WHERE x.qid = s.qid AND x.r <= s.i + 1 AND score >= 0.85)
             OR (s.last <> 0 AND s.i + 1 >= 3 AND s.last + (SELECT count(*) FROM scored x WHERE x.qid = s.qid AND x.r <= s.i + 1 AND score >= 0.6) - s.last <= 1)
           THEN s.i + 1 ELSE 0 END
    FROM stops s WHERE s.stop = 0),
  placed AS (
    SELECT scored.qid, id, r AS round, score, price, row_number() OVER (PARTITION BY scored.qid ORDER BY round(score, 9) DESC, price DESC, r, id) AS place
    FROM scored JOIN stops ON scored.qid = stops.qid AND stop > 0 JOIN docs USING (id) WHERE score >= 0.6 AND r <= stop)
  SELECT qid::INT AS qid, place::INT AS place, round(score, 6) AS score, round::INT AS round, id FROM placed WHERE place <= {limit}"""


@_query(_fields_sql(15))
def fuzzy_search_fields(spark, d):
    """Three weighted fields, one with several values; ties go by price."""
    df = goods(spark, d)
    asked = spark.createDataFrame(list(enumerate(ASKED)), "qid int, query string")
    return fuzzy.search(asked, df, stored_index(spark, df, GOODS), 15).select("qid", "place", F.round("score", 6).alias("score"), "round", "id")


@_query("SELECT count(DISTINCT p_name) AS n, 1.0::DOUBLE AS hit_rate, 1.0::DOUBLE AS mean_score FROM part")
def search_benchmark_exact(spark, d):
    """Every name as it is: how many searches have it first, and the mean score of that."""
    return _benchmark(spark, d, lambda name: name)


@_query()
def search_benchmark_typos(spark, d):
    """Every name misspelt: the share of searches that have a row of the name among the first ten, and the mean score of the first one."""
    return _benchmark(spark, d, lambda name: typos.with_typos(name, F.lit(1)))


def _benchmark(spark, d, spelled) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    asked = names.select(F.xxhash64("name").alias("qid"), spelled(F.col("name")).alias("query"), F.col("name").alias("wanted"))
    df = named_parts(spark, d)
    found = fuzzy.search(asked.select("qid", "query"), df, stored_index(spark, df, NAMES), 10)
    best = found.groupBy("qid").agg(F.collect_set("name").alias("names"), F.max("score").alias("score"))
    hit = asked.join(best, "qid", "left").select(F.coalesce(F.array_contains("names", F.col("wanted")), F.lit(False)).cast("double").alias("hit"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return hit.agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("score"), 6).alias("mean_score"))
