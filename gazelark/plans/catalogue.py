"""The named queries over the driver's tables, each with its SQL where SQL can express it.

The tables stand in for the entity tables: region for countries, nation for subdivisions, customer and supplier for cities with
their balance as population, part for texts with aliases, documents for long texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import fts, fuzzy, hierarchy, lookup
from ..session import scratch, spread
from ..sources import readers, tables
from ..spec import EntitySpec
from . import etl, registries

Query = Callable[[SparkSession, str], DataFrame]

PARTS = EntitySpec("parts", ("name", "brand", "type"), stored=("size", "price"), get_keys=("id", "name", "brand"), filters={"name": "name", "brand": "brand", "type": "type"}, weights={"name": 1.0})
NAMES = EntitySpec("names", ("name",), filters={"name": "name"}, weights={"name": 1.0})
ITEMS = EntitySpec("items", ("name",), filters={"name": "name"})
REGIONS = EntitySpec("regions", ("name", "alpha2", "alpha3"), get_keys=("id", "alpha2", "alpha3", "numeric"), filters={"name": "name"})
NATIONS = EntitySpec("nations", ("name", "country"), get_keys=("id", "name"))

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- the driver's tables in the engine's roles


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def named_parts(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("id", "name")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("name"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    return r.select((F.col("r_regionkey") + 1).cast("bigint").alias("id"), F.col("r_name").alias("name"), F.substring("r_name", 1, 2).alias("alpha2"), F.substring("r_name", 1, 3).alias("alpha3"), (F.col("r_regionkey") * 7 + 3).cast("string").alias("numeric"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.col("r_name")
    return n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), text.join_bar(name, F.substring(name, 1, 2), F.substring(name, 1, 3)).alias("country"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") % 5 + 1).alias("parent_id"))


def places(spark: SparkSession, d: str) -> DataFrame:
    """Customers as cities: their nation as admin1, the nation five further on as admin2, their balance as population."""
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    name = F.col("r_name")
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 4 != 0, F.concat(F.lit("n"), F.col("c_nationkey"))).alias("admin1"), F.concat(F.lit("n"), (F.col("c_nationkey") + 5) % 25).alias("admin2"), text.join_bar(name, F.substring(name, 1, 2), F.substring(name, 1, 3)).alias("country"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").alias("population"))


_REGIONS = "(SELECT (r_regionkey + 1)::BIGINT AS id, r_name AS name, r_name[1:2] AS alpha2, r_name[1:3] AS alpha3, (r_regionkey * 7 + 3)::VARCHAR AS numeric FROM region)"
_NATIONS = "(SELECT n_nationkey::BIGINT AS id, n_name AS name, r_name || '|' || r_name[1:2] || '|' || r_name[1:3] AS country, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 5 + 1 END AS parent_id FROM nation JOIN region ON n_regionkey = r_regionkey)"
_PLACES = "(SELECT c_custkey AS id, c_name AS name, CASE WHEN c_nationkey % 4 <> 0 THEN 'n' || c_nationkey END AS admin1, 'n' || ((c_nationkey + 5) % 25) AS admin2, r_name || '|' || r_name[1:2] || '|' || r_name[1:3] AS country, c_mktsegment AS type, c_acctbal AS population FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_PARTS = "(SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price FROM part)"
_ITEMS = "(SELECT item_id AS id, text AS name FROM benchmark)"


# --- gets


@_query(f"SELECT * FROM {_PARTS} WHERE id = 17")
def get_by_id(spark, d):
    return lookup.get(parts(spark, d), PARTS, id="17")


@_query(f"SELECT * FROM {_REGIONS} ORDER BY id LIMIT 1")
def get_by_code(spark, d):
    return lookup.get(regions(spark, d), REGIONS, numeric=3)


@_query(f"SELECT * FROM {_PARTS} WHERE brand = 'Brand#4' ORDER BY id LIMIT 1")
def get_multi_key_precedence(spark, d):
    return lookup.get(parts(spark, d), PARTS, id=3, name="red widget", brand="Brand#4")


@_query(f"SELECT * FROM {_PARTS} WHERE false")
def get_missing(spark, d):
    return lookup.get(parts(spark, d), PARTS, id=-1).unionByName(lookup.get(parts(spark, d), PARTS, pid=1))


@_query(f"SELECT o_orderkey, p.id, p.name FROM (SELECT o_orderkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1) k JOIN {_PARTS} p ON k.l_partkey = p.id")
def batch_get_join(spark, d):
    keys = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    keys = keys.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return lookup.batch_get(keys, parts(spark, d), "l_partkey", "id").select("o_orderkey", "id", "name")


# --- scans


@_query(f"SELECT * FROM {_PARTS}")
def scan_all(spark, d):
    return lookup.scan(parts(spark, d), PARTS)


@_query(f"SELECT * FROM {_PARTS} ORDER BY id LIMIT 10 OFFSET 20")
def slice_rows(spark, d):
    return lookup.sliced(parts(spark, d), PARTS, 20, 30)


@_query(f"SELECT * EXCLUDE (n, c) FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n, count(*) OVER () AS c FROM {_PARTS}) WHERE n >= c - 9 AND n < c - 1 AND (n - (c - 9)) % 3 = 0")
def slice_from_end(spark, d):
    return lookup.sliced(parts(spark, d), PARTS, -9, -1, 3)


@_query("SELECT count(*) AS n FROM part")
def count_rows(spark, d):
    return parts(spark, d).agg(F.count("*").alias("n"))


# --- predicates

_DOC_PREDICATES = {
    "pred_eq": (lambda: lookup.equals(PARTS, "name", "red widget"), "name = 'red widget'"),
    "pred_eq_stored": (lambda: lookup.equals(PARTS, "size", 11), "false"),
    "pred_eq_blank": (lambda: lookup.equals(PARTS, "name", "") | lookup.equals(PARTS, "name", "!@#$%"), "false"),
    "pred_ne": (lambda: lookup.differs("type", "SMALL"), "type <> 'SMALL'"),
    "pred_lt_text": (lambda: lookup.compared("size", "<", 3), "size::VARCHAR < '3'"),
    "pred_lt_number": (lambda: lookup.compared("size", "<", 3, numeric=True), "size < 3"),
    "pred_le": (lambda: lookup.compared("name", "<=", "hot bolt"), "name <= 'hot bolt'"),
    "pred_gt": (lambda: lookup.compared("brand", ">", "Brand#2"), "brand > 'Brand#2'"),
    "pred_ge": (lambda: lookup.compared("size", ">=", 45), "size::VARCHAR >= '45'"),
    "pred_like": (lambda: lookup.is_like("name", "%RED w_dget"), "name ILIKE '%RED w_dget'"),
    "pred_isin": (lambda: lookup.is_in("size", [1, 2, 50]), "size IN (1, 2, 50)"),
    "pred_and": (lambda: lookup.equals(PARTS, "type", "SMALL") & lookup.compared("price", ">", 950, numeric=True), "type = 'SMALL' AND price > 950"),
    "pred_or": (lambda: lookup.equals(PARTS, "name", "red widget") | lookup.equals(PARTS, "name", "blue bolt"), "name IN ('red widget', 'blue bolt')"),
}
for _name, (_where, _sql) in _DOC_PREDICATES.items():
    _QUERIES[_name] = lambda spark, d, where=_where: lookup.select(parts(spark, d), where())
    _SQL[_name] = f"SELECT * FROM {_PARTS} WHERE {_sql}"


@_query(f"SELECT * FROM {_PARTS} ORDER BY price DESC, id LIMIT 25")
def select_order_limit(spark, d):
    return lookup.select(parts(spark, d), order_by=[F.col("price").desc(), "id"], limit=25)


# --- full text


def _hits_sql(field: str, words: list[str], prefix: bool) -> str:
    tests = [f"starts_with({field}[i + {k}], '{w}')" if prefix and k == len(words) - 1 else f"{field}[i + {k}] = '{w}'" for k, w in enumerate(words)]
    return f"len(list_filter(generate_series(1, len({field})), lambda i: {' AND '.join(tests)}))"


def _bm25_sql(source: str, fields: list[str], phrases: list[tuple[str | None, list[str], bool]]) -> str:
    """(id, rank) of rows with all phrases; phrases: (only field, words, whether the last word is a prefix)."""
    token_lists = ", ".join(rf"regexp_extract_all(lower(strip_accents({f})), '[\p{{L}}\p{{N}}]+') AS {f}" for f in fields)
    size = " + ".join(f"len({f})" for f in fields)
    tf = [" + ".join(f"{50.0 if f == fields[0] else 1.0} * {_hits_sql(f, w, p)}" for f in fields if only in (None, f)) for only, w, p in phrases]
    score = " + ".join(
        f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(phrases))
    )
    return f"""
      (WITH tok AS (SELECT id, {token_lists} FROM {source}),
       h AS (SELECT id, {size} AS size, {", ".join(f"({x}) AS t{i}" for i, x in enumerate(tf))} FROM tok),
       s AS (SELECT count(*) AS n, avg(size) AS mean, {", ".join(f"sum((t{i} > 0)::INT) AS n{i}" for i in range(len(phrases)))} FROM h)
       SELECT id, round(-({score}), 6) AS rank FROM h, s WHERE {" AND ".join(f"t{i} > 0" for i in range(len(phrases)))})"""


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("rank", 6).alias("rank"))


#: Where indexes of this application lie, by table and files.
_INDEXES: dict[tuple, str] = {}


def stored_index(spark: SparkSession, df: DataFrame, spec: EntitySpec) -> fts.TextIndex:
    """The table's index, sorted by token: written by the first query that needs it, read by all; a lookup reads its tokens' row groups."""
    kind = (spark.sparkContext.applicationId, spec.name, tuple(sorted(df.inputFiles())))
    if kind not in _INDEXES or not tables.exists(spark, f"{_INDEXES[kind]}/sizes"):
        path = scratch(spark, "index")
        fts.TextIndex.build(spread(df, spec.key), spec).write(path)
        _INDEXES[kind] = path
    return fts.TextIndex.read(spark, _INDEXES[kind], spec)


_PF = ["name", "brand", "type"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parts(spark, sf_dir)
    return fts.filtered(df, stored_index(spark, df, PARTS), limit=20, name="small")


@_query(f"SELECT * FROM {_bm25_sql(_PARTS, _PF, [(None, ['small'], False), (None, ['brand'], False)])}")
def fts_all_columns(spark, d):
    return _ranked(fts.fts_match(stored_index(spark, parts(spark, d), PARTS), "SMALL brand"))


@_query(f"SELECT * FROM {_bm25_sql(_PARTS, _PF, [('type', ['small'], False)])}")
def fts_one_column(spark, d):
    return _ranked(fts.fts_match(stored_index(spark, parts(spark, d), PARTS), fields={"type": "small"}))


@_query(f"SELECT * FROM {_bm25_sql(_PARTS, _PF, [('name', ['small'], False), ('name', ['gear'], False), ('type', ['small'], False)])}")
def fts_multi_column(spark, d):
    return _ranked(fts.fts_match(stored_index(spark, parts(spark, d), PARTS), "ignored", {"name": "gear small", "type": "SMALL"}))


@_query(f"SELECT * FROM {_bm25_sql(_PARTS, _PF, [(None, ['sm'], True), (None, ['g'], True)])}")
def fts_prefix(spark, d):
    return _ranked(fts.fts_match(stored_index(spark, parts(spark, d), PARTS), "sm g", exact=False))


@_query(f"SELECT * FROM {_bm25_sql(_PARTS, _PF, [(None, ['brand', '4'], False), (None, ['economy'], False)])}")
def fts_phrase(spark, d):
    return _ranked(fts.fts_match(stored_index(spark, parts(spark, d), PARTS), "Brand#4 economy"))


@_query(f"SELECT id, rank FROM {_bm25_sql(_ITEMS, ['name'], [(None, ['that'], False), (None, ['the'], False)])} ORDER BY rank, id LIMIT 15")
def fts_bm25_topk(spark, d):
    df = items(spark, d)
    return _ranked(fts.filtered(df, stored_index(spark, df, ITEMS), "that the", limit=15))


_DOCS = "(SELECT doc_id AS id, text AS name FROM documents)"


@_query(f"SELECT * FROM {_bm25_sql(_DOCS, ['name'], [(None, ['ete'], True), (None, ['la'], True)])}")
def fts_documents_folded(spark, d):
    df = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"))
    return _ranked(fts.fts_match(stored_index(spark, df, ITEMS), "ÉTÉ la", exact=False))


@_query(f"SELECT p.id, p.name, p.size FROM {_PARTS} p WHERE list_contains(string_split(name, ' '), 'small') ORDER BY size, id LIMIT 12")
def fts_order_by(spark, d):
    df = parts(spark, d)
    return fts.filtered(df, stored_index(spark, df, PARTS), order_by=("size",), limit=12, name="small").select("id", "name", "size")


@_query(f"SELECT id, rank FROM {_bm25_sql(_PARTS, _PF, [(None, ['ring'], False)])} ORDER BY rank, id LIMIT 7 OFFSET 5")
def fts_limit_offset(spark, d):
    df = parts(spark, d)
    return _ranked(fts.filtered(df, stored_index(spark, df, PARTS), "ring", limit=7, offset=5))


@_query(f"SELECT *, 0.0::DOUBLE AS rank FROM {_PARTS} WHERE false")
def filter_unknown_kwarg(spark, d):
    df = parts(spark, d)
    return fts.filtered(df, stored_index(spark, df, PARTS), colour="red")


@_query(f"SELECT *, 0.0::DOUBLE AS rank FROM {_PARTS} WHERE false")
def filter_falsy(spark, d):
    df = parts(spark, d)
    return fts.filtered(df, stored_index(spark, df, PARTS), "")


@_query(f"SELECT id, name FROM {_PARTS} WHERE false")
def filter_punctuation(spark, d):
    df = parts(spark, d)
    return fts.filtered(df, stored_index(spark, df, PARTS), "!@#$%").select("id", "name")


# --- hierarchy

_FIRST_REGION = f"(SELECT name || '|' || alpha2 || '|' || alpha3 FROM {_REGIONS} WHERE id = 2)"


@_query(f"SELECT id, name, country FROM {_NATIONS} WHERE country = {_FIRST_REGION} AND (CASE WHEN parent_id IS NULL THEN 1 ELSE 2 END) = 1")
def for_country(spark, d):
    return hierarchy.for_country(regions(spark, d), REGIONS, nations(spark, d), level=1, id=2).select("id", "name", "country")


@_query(f"SELECT id, population FROM {_PLACES} WHERE country = {_FIRST_REGION} AND population > 5000")
def for_country_range_gt(spark, d):
    return hierarchy.for_country(regions(spark, d), REGIONS, places(spark, d), range_column="population", above=5000, numeric=10).select("id", "population")


@_query(f"SELECT id, population FROM {_PLACES} WHERE country = {_FIRST_REGION} AND population < 0")
def for_country_range_lt(spark, d):
    return hierarchy.for_country(regions(spark, d), REGIONS, places(spark, d), range_column="population", below=0, id=2).select("id", "population")


_PARENTS = "(SELECT 'n' || n_nationkey AS k FROM nation)"
_FALLBACK = f"""
  SELECT p.id, p.admin1, p.admin2, k.k AS parent FROM {_PLACES} p JOIN {_PARENTS} k ON p.admin1 = k.k WHERE population > 9000
  UNION ALL
  SELECT p.id, p.admin1, p.admin2, k.k FROM {_PLACES} p JOIN {_PARENTS} k ON p.admin2 = k.k
  WHERE population > 9000 AND k.k NOT IN (SELECT admin1 FROM {_PLACES} WHERE population > 9000 AND admin1 IS NOT NULL)"""


@_query(f"SELECT id, admin1, admin2 FROM {_PLACES} WHERE admin1 = 'n6' AND population > 1000")
def for_subdivision(spark, d):
    parent = table(spark, d, "nation").where("n_nationkey = 6")
    return hierarchy.for_subdivision(parent, F.concat(F.lit("n"), "n_nationkey"), places(spark, d), "admin1", "admin2", "population", above=1000).select("id", "admin1", "admin2")


@_query(f"SELECT id, admin1, admin2 FROM ({_FALLBACK})")
def for_subdivision_fallback(spark, d):
    """All nations at once: those with no place in the range under admin1 fall back to admin2."""
    return hierarchy.for_subdivision(table(spark, d, "nation"), F.concat(F.lit("n"), "n_nationkey"), places(spark, d), "admin1", "admin2", "population", above=9000).select("id", "admin1", "admin2")


@_query(f"SELECT DISTINCT type FROM {_PLACES} WHERE country = {_FIRST_REGION}")
def types_for_country(spark, d):
    df = places(spark, d).withColumn("parent_id", F.lit(None).cast("int"))
    return hierarchy.types_for_country(regions(spark, d), REGIONS, df, level=1, id=2)


@_query(f"SELECT id, CASE WHEN parent_id IS NULL THEN 1 ELSE 2 END AS admin_level FROM {_NATIONS} WHERE parent_id IS NOT NULL")
def admin_level_filter(spark, d):
    return nations(spark, d).select("id", hierarchy.admin_level().alias("admin_level")).where("admin_level = 2")


@_query(f"SELECT a.id, a.name, b.name AS parent_name FROM {_NATIONS} a LEFT JOIN {_NATIONS} b ON a.parent_id = b.id")
def parent_lookup(spark, d):
    return hierarchy.with_parents(nations(spark, d)).select("id", "name", "parent_name")


# --- records and scalar functions


@_query("SELECT n.id, split_part(country, '|', 1) AS name, split_part(country, '|', 2) AS alpha2, split_part(country, '|', 3) AS alpha3 FROM " + _NATIONS + " n")
def compound_split(spark, d):
    return nations(spark, d).select("id", text.compound("country", ("name", "alpha2", "alpha3"), strict=True).alias("c")).select("id", "c.*")


@_query(f"SELECT id, concat_ws(', ', name, admin2, admin1, split_part(country, '|', 1)) AS display_name FROM {_PLACES}")
def display_name(spark, d):
    return places(spark, d).select("id", registries.display_name().alias("display_name"))


@_query("SELECT '{\"id\":' || p_partkey || ',\"name\":\"' || p_name || '\",\"size\":' || CASE WHEN p_size > 9 THEN p_size::VARCHAR ELSE 'null' END || '}' AS record FROM part")
def record_json(spark, d):
    return lookup.as_records(parts(spark, d).select("id", "name", F.when(F.col("size") > 9, F.col("size")).alias("size")))


@_query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN text END AS cleaned FROM documents")
def clean_row(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean("text").alias("cleaned"))


@_query("SELECT o_orderkey, printf('%08d', o_orderkey * 1013) AS padded FROM orders")
def zero_pad(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.zero_padded(F.col("o_orderkey") * 1013).alias("padded"))


@_query("SELECT doc_id, strip_accents(text) AS folded FROM documents")
def fold_diacritics(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fold_diacritics("text").alias("folded"))


@_query(r"""
  SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(p_name || '-' || p_type || ' ' || p_brand, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', '') AS titled
  FROM part""")
def title_case(spark, d):
    return table(spark, d, "part").select("p_partkey", text.titled(F.concat(F.concat_ws("-", "p_name", "p_type"), F.lit(" "), F.col("p_brand"))).alias("titled"))


@_query("""
  SELECT p_name, array_to_string(list_sort(list(v)), '|') AS names
  FROM (SELECT p_name, upper(p_type) AS v FROM part UNION SELECT p_name, p_brand FROM part) GROUP BY p_name""")
def dedupe_ci(spark, d):
    rows = table(spark, d, "part").groupBy("p_name").agg(F.array_sort(F.collect_set(F.concat_ws("|", "p_type", F.lower("p_type"), "p_brand"))).alias("s"))
    every = F.flatten(F.transform("s", lambda x: F.split(x, r"\|")))
    return rows.select("p_name", F.array_join(text.deduped(every), "|").alias("names"))


@_query("SELECT p_partkey, ('0x' || md5(p_brand || '|' || p_size || '|' || p_name || '|' || p_type)[1:16])::UBIGINT::VARCHAR AS id FROM part")
def md5_id(spark, d):
    """The id as text: it is an unsigned number of 64 bits."""
    return table(spark, d, "part").select("p_partkey", text.hash_id("p_brand", "p_size", "p_name", "p_type").cast("string").alias("id"))


@_query(r"SELECT doc_id, NOT regexp_matches(text, '[^\p{Latin} ''’-]') AS latin FROM documents UNION ALL SELECT -c_custkey, true FROM customer")
def latin_filter(spark, d):
    """Whole texts, and market segments, which are words of letters."""
    segments = table(spark, d, "customer").select((-F.col("c_custkey")).alias("doc_id"), text.is_latin("c_mktsegment").alias("latin"))
    return table(spark, d, "documents").select("doc_id", text.is_latin("text").alias("latin")).unionByName(segments)


#: Each part's name beside the next one's.
_NAME_PAIRS = "(SELECT a.p_partkey AS id, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def _name_pairs(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("b")), "id")


@_query(f"""
  SELECT id, 90 - CASE WHEN (length(a) + length(b)) / 2 <= 5 THEN 15 WHEN (length(a) + length(b)) / 2 <= 8 THEN 10 WHEN (length(a) + length(b)) / 2 <= 12 THEN 5 ELSE 0 END
         - CASE WHEN greatest(len(string_split(a, ' ')), len(string_split(b, ' '))) = 1 THEN 5 ELSE 0 END AS threshold FROM {_NAME_PAIRS}""")
def adaptive_threshold(spark, d):
    return _name_pairs(spark, d).select("id", text.match_threshold("a", "b").alias("threshold"))


@_query(f"""
  SELECT id, (a LIKE '%bolt%') <> (b LIKE '%bolt%') AS differ FROM {_NAME_PAIRS}""")
def directional_mismatch(spark, d):
    north = lambda c: F.replace(F.col(c), F.lit("bolt"), F.lit("North"))
    return _name_pairs(spark, d).select("id", text.directions_differ(north("a"), north("b")).alias("differ"))


_LCS = """
  lcs AS (
    WITH RECURSIVE run(x, y, i, best) AS (
      SELECT x, y, 0, list_transform(generate_series(0, length(y)), lambda j: 0) FROM (SELECT DISTINCT x, y FROM pairs)
      UNION ALL
      SELECT x, y, i + 1, list_transform(generate_series(0, length(y)), lambda j: list_max(list_transform(generate_series(0, j), lambda k: CASE WHEN k > 0 AND y[k:k] = x[i+1:i+1] THEN best[k] + 1 ELSE best[k+1] END)))
      FROM run WHERE i < length(x))
    SELECT x, y, best[len(best)] AS n FROM run WHERE i = length(x))"""


@_query(f"""
  WITH pairs AS (SELECT a AS x, b AS y FROM {_NAME_PAIRS}), {_LCS}
  SELECT id, round(100.0 * (1 - (length(x) + length(y) - 2 * n) / (length(x) + length(y))), 6) AS ratio FROM {_NAME_PAIRS} JOIN lcs ON a = x AND b = y""")
def indel_ratio(spark, d):
    return _name_pairs(spark, d).select("id", F.round(similarity.indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


def _set_ratio_sql(pairs: str) -> str:
    """CTEs up to ratios(a, b, ratio) for pairs (a, b)."""
    return f"""
  wanted AS ({pairs}),
  sets AS (
    SELECT a, b, list_sort(list_distinct(list_filter(string_split(a, ' '), lambda w: w <> ''))) AS wa, list_sort(list_distinct(list_filter(string_split(b, ' '), lambda w: w <> ''))) AS wb FROM wanted),
  rests AS (
    SELECT a, b, wa, wb, array_to_string(list_filter(wa, lambda w: list_contains(wb, w)), ' ') AS c, array_to_string(list_filter(wa, lambda w: NOT list_contains(wb, w)), ' ') AS x,
           array_to_string(list_filter(wb, lambda w: NOT list_contains(wa, w)), ' ') AS y FROM sets),
  pairs AS (SELECT x, y FROM rests), {_LCS},
  sized AS (SELECT r.*, l.n AS common, length(c) AS s, length(r.x) AS la, length(r.y) AS lb, (c <> '')::INT AS g FROM rests r JOIN lcs l ON r.x = l.x AND r.y = l.y),
  ratios AS (
    SELECT a, b, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0 WHEN s > 0 AND (la = 0 OR lb = 0) THEN 100
      ELSE 100 * greatest(1 - (la + lb - 2 * common) / (2 * (s + g) + la + lb), CASE WHEN s > 0 THEN 1 - (g + la) / (2 * s + g + la) ELSE 0 END, CASE WHEN s > 0 THEN 1 - (g + lb) / (2 * s + g + lb) ELSE 0 END) END AS ratio
    FROM sized)"""


@_query(f"WITH {_set_ratio_sql(f'SELECT DISTINCT a, b FROM {_NAME_PAIRS}')} SELECT id, round(ratio, 6) AS ratio FROM {_NAME_PAIRS} JOIN ratios USING (a, b)")
def token_set_ratio(spark, d):
    return _name_pairs(spark, d).select("id", F.round(similarity.token_set_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


# --- fuzzy search

TYPOS = ("blue wigdet", "smal gizmo", "colld anvl", "red rnig", "hot", "zzzzzzzzz", "large gear", "nwe plate")


def _search_sql(queries: tuple[str, ...], limit: int) -> str:
    values = ", ".join(f"({i}, '{q}')" for i, q in enumerate(queries))
    return f"""
  WITH RECURSIVE q AS (SELECT * FROM (VALUES {values}) AS v(qid, query)),
  docs AS (SELECT p_name AS name, p_partkey AS id FROM part),
  qw AS (SELECT qid, query, unnest(string_split(query, ' ')) AS w, generate_subscripts(string_split(query, ' '), 1) AS no FROM q),
  lengths AS (SELECT qid, max(length(w)) AS rounds, count(*) AS words FROM qw GROUP BY qid),
  dw AS (SELECT id, unnest(string_split(name, ' ')) AS t FROM docs),
  came AS (
    SELECT qid, no, id, min(CASE WHEN w = t THEN 1 ELSE greatest(2, 1 + length(w) - list_max(list_filter(generate_series(0, length(w)), lambda k: starts_with(t, w[1:k])))) END) AS r
    FROM qw, dw WHERE w[1:1] = t[1:1] GROUP BY qid, no, id),
  rows_ AS (SELECT qid, id, max(r) AS r FROM came JOIN lengths USING (qid) WHERE r <= rounds GROUP BY qid, id, words HAVING count(*) = words),
  {_set_ratio_sql("SELECT DISTINCT q.query AS a, docs.name AS b FROM rows_ JOIN q USING (qid) JOIN docs USING (id)")},
  scored AS (
    SELECT rows_.qid, id, r, name, CASE WHEN ratio >= 60 THEN ratio / 100 ELSE 0 END AS score
    FROM rows_ JOIN q USING (qid) JOIN docs USING (id) JOIN ratios ON a = query AND b = name),
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
    SELECT scored.qid, id, name, r AS round, score, row_number() OVER (PARTITION BY scored.qid ORDER BY score DESC, r, id) AS place
    FROM scored JOIN stops ON scored.qid = stops.qid AND stop > 0 WHERE score >= 0.6 AND r <= stop)
  SELECT qid::INT AS qid, place::INT AS place, round(score, 6) AS score, round::INT AS round, id, name FROM placed WHERE place <= {limit}"""


def _searched(spark, d, queries: tuple[str, ...], limit: int) -> DataFrame:
    df = named_parts(spark, d)
    asked = spark.createDataFrame(list(enumerate(queries)), "qid int, query string")
    return fuzzy.search(asked, df, stored_index(spark, df, NAMES), limit).select("qid", "place", F.round("score", 6).alias("score"), "round", "id", "name")


@_query(_search_sql(TYPOS[:1], 5))
def fuzzy_search_single(spark, d):
    return _searched(spark, d, TYPOS[:1], 5)


@_query(_search_sql(TYPOS, 15))
def fuzzy_search_batch(spark, d):
    return _searched(spark, d, TYPOS, 15)


@_query(_search_sql(TYPOS, 15).rsplit("SELECT qid::INT", 1)[0] + "SELECT s.qid::INT AS qid, max(stop)::INT AS stop FROM stops s WHERE s.qid IN (SELECT qid FROM rows_) GROUP BY s.qid")
def fuzzy_stop_rule(spark, d):
    df = named_parts(spark, d)
    asked = spark.createDataFrame(list(enumerate(TYPOS)), "qid int, query string")
    came = fuzzy.rounds_of_rows(asked, df, stored_index(spark, df, NAMES)).join(asked, "qid").join(df, "id")
    return fuzzy.stop_rounds(came.select("qid", "rounds", "round", fuzzy.weighted_score(F.lower("query"), {"name": 1.0}).alias("score")))


# --- building tables


@_query("SELECT p_partkey, p_type, p_size FROM part WHERE p_type IN ('SMALL', 'PPL') AND p_size::VARCHAR NOT IN ('', '0')")
def etl_feature_filter(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size", F.when(F.col("p_type") == "SMALL", "PPL").otherwise("X").alias("feature code"), F.col("p_size").cast("string").alias("population"))
    return p.where(etl.is_city()).select("p_partkey", "p_type", "p_size")


@_query("SELECT row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_custkey) AS id, c_custkey FROM customer")
def etl_dense_ids(spark, d):
    return lookup.with_ids(table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), "c_nationkey", "c_mktsegment", "c_custkey").select("id", "c_custkey")


@_query("SELECT event_type || ':' || user_id AS key, arg_max(props, event_id) AS value FROM events GROUP BY ALL")
def etl_upsert_meta(spark, d):
    """The earlier half of the events is in the store, the later half changes it: the last one of a key wins."""
    events = table(spark, d, "events").select(F.concat_ws(":", "event_type", "user_id").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    middle = F.lit(events.agg(F.avg("seq").alias("middle")).first()["middle"])
    store, changes = events.where(F.col("seq") < middle), events.where(F.col("seq") >= middle)
    return tables.upserted(tables.upserted(store.limit(0), store), changes).select("key", "value")


@_query("SELECT n_name, [r_name, r_name[1:2]] AS codes, 'AR' || n_nationkey || '.' || n_regionkey AS parent_code FROM nation JOIN region ON n_regionkey = r_regionkey")
def etl_code_parsing(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    coded = n.select("n_name", F.array("r_name", F.substring("r_name", 1, 2)).alias("codes"), F.concat(F.lit("AR"), "n_nationkey", F.lit("."), "n_regionkey", F.lit(".7")).alias("code"))
    return etl.parsed_codes(coded).select("n_name", "codes", "parent_code")


@_query("SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: w <> 'small'), ' ') AS cleaned FROM part")
def etl_comparable_name(spark, d):
    words = F.replace(F.initcap("p_name"), F.lit("Small"), F.lit("Oblast,"))
    return table(spark, d, "part").select("p_partkey", text.comparable(words).alias("cleaned"))


@_query("SELECT p_brand AS key, arg_max(p_name, p_partkey) AS value FROM part GROUP BY p_brand")
def etl_lookup_last_wins(spark, d):
    return readers.lookup_table(table(spark, d, "part"), "p_brand", F.col("p_name"), "p_partkey")


from . import build_catalogue, search_catalogue  # noqa: E402, F401  (they add their own queries)
