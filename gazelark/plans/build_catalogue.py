"""Named queries that go through readers, writers, the registries and the building of tables, each with its SQL.

What readers read is written from the driver's tables first, into the folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text, typos
from ..operators import fts
from ..session import scratch, spread
from ..sources import readers, tables
from . import etl, registries
from .catalogue import _NATIONS, _PARTS, _PLACES, _REGIONS, PARTS, _bm25_sql, _query, nations, parts, places, regions, table

_TITLED = "list_aggregate(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', '')"

#: Names of nations that no two of are alike, as the tables' own differ by a number alone.
_APART = "(SELECT n_nationkey, n_regionkey, md5(n_name)[1:14] AS n_name FROM nation)"


# --- files


def _countries_file(spark, d) -> str:
    """Regions as a countries file, in order of key."""
    r = regions(spark, d).orderBy("id")
    path = scratch(spark, "countries")
    tables.write_tsv(r.select("name", F.concat(F.lit("The "), "name").alias("official_name"), "alpha2", "alpha3", "numeric", F.concat_ws("|", F.lower("name"), "alpha3").alias("alt_names"), F.when(F.col("id") > 2, "f").alias("flag")), path, readers.COUNTRY_COLUMNS)
    return path


@_query(f"SELECT id, name, 'The ' || name AS official_name, alpha2, alpha3, numeric::INT AS numeric, lower(name) || '|' || alpha3 AS alts, CASE WHEN id > 2 THEN 'f' END AS flag FROM {_REGIONS}")
def country_records(spark, d):
    """A countries file written, read with its header, numbered in its order and typed."""
    registry = registries.Countries.read(spark, _countries_file(spark, d))
    return registry.records().select("id", "name", "official_name", "alpha2", "alpha3", "numeric", F.array_join("alt_names", "|").alias("alts"), "flag")


@_query(f"SELECT count(*) AS n, (SELECT count(*) FROM customer) AS cities, min(name) AS first, max(name) AS last FROM {_REGIONS}")
def registry_lifecycle(spark, d):
    """Tables registered and counted, iterated over, taken off again and registered anew."""
    countries = registries.Countries.read(spark, _countries_file(spark, d))
    names = [r["name"] for r in countries]
    sizes = (len(countries), len(countries))  # the second one is remembered
    countries.unregister()
    cities = registries.Cities()
    cities.load(spark, _cities_file(spark, d))
    row = (sizes[1], cities.count, min(names), max(names))
    cities.unregister()
    return spark.createDataFrame([row], "n long, cities long, first string, last string")


def _admin(code, name):
    return F.when(code.isNotNull(), F.concat_ws("|", name, code, F.lit("")))


def _cities_file(spark, d) -> str:
    p = places(spark, d)
    path = scratch(spark, "cities")
    rows = p.select(F.col("id").alias("geonames_id"), "name", F.concat_ws("|", "type", F.lower("name")).alias("alt_names"), _admin(F.col("admin1"), F.upper("admin1")).alias("admin1"), _admin(F.col("admin2"), F.upper("admin2")).alias("admin2"), "country", text.zero_padded(F.abs(F.round("population")).cast("long")).alias("population"), F.lit("1.5").alias("lat"), F.lit("-2").alias("lng"))
    tables.write_tsv(rows, path, readers.CITY_COLUMNS)
    return path


_CITY_RECORDS = f"""
  SELECT id AS geonames_id, concat_ws(', ', name, upper(admin2), upper(admin1), split_part(country, '|', 1)) AS display_name, (admin1 IS NOT NULL)::INT + 1 AS levels, admin2 AS lowest_code,
         split_part(country, '|', 2) AS alpha2, abs(round(population))::BIGINT AS population, 1.5::DOUBLE AS lat, -2.0::DOUBLE AS lng, type || '|' || lower(name) AS alts FROM {_PLACES}"""


@_query(_CITY_RECORDS)
def city_records(spark, d):
    registry = registries.Cities()
    registry.load(spark, _cities_file(spark, d))
    lowest = F.element_at("subdivisions", -1)
    return registry.records().select("geonames_id", "display_name", F.size("subdivisions").alias("levels"), lowest["geonames_code"].alias("lowest_code"), F.col("country.alpha2").alias("alpha2"), "population", "lat", "lng", F.array_join("alt_names", "|").alias("alts"))


@_query(f"SELECT * FROM ({_CITY_RECORDS}) WHERE geonames_id = 7")
def city_get(spark, d):
    registry = registries.Cities()
    registry.load(spark, _cities_file(spark, d))
    found = registry.get(geonames_id=7)
    return registry.records(found).select("geonames_id", "display_name", F.size("subdivisions").alias("levels"), F.element_at("subdivisions", -1)["geonames_code"].alias("lowest_code"), F.col("country.alpha2").alias("alpha2"), "population", "lat", "lng", F.array_join("alt_names", "|").alias("alts"))


def _subdivisions(spark, d) -> registries.Subdivisions:
    n = nations(spark, d).select("id", "name", F.lower("name").alias("alt_names"), F.concat(F.lit("G."), "id").alias("geonames_code"), F.concat(F.lit("I-"), "id").alias("iso_code"), "country", F.when(F.col("id") % 2 == 0, "State").otherwise("Land").alias("type"), F.col("parent_id").cast("string").alias("parent_id"))
    return registries.Subdivisions(n, registries.Countries(regions(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("official_name", "alt_names", "flag")})))


_SUBDIVISIONS = f"(SELECT id, name, lower(name) AS alt_names, 'G.' || id AS geonames_code, 'I-' || id AS iso_code, country, CASE WHEN id % 2 = 0 THEN 'State' ELSE 'Land' END AS type, parent_id FROM {_NATIONS})"


@_query(f"SELECT id, name, alt_names AS alts, geonames_code, iso_code, split_part(country, '|', 3) AS alpha3, type, parent_id::BIGINT AS parent_id, CASE WHEN parent_id IS NULL THEN 1 ELSE 2 END AS admin_level FROM {_SUBDIVISIONS}")
def subdivision_records(spark, d):
    return _subdivisions(spark, d).records().select("id", "name", F.array_join("alt_names", "|").alias("alts"), "geonames_code", "iso_code", F.col("country.alpha3").alias("alpha3"), "type", "parent_id", "admin_level")


@_query(f"SELECT id, name, iso_code FROM {_SUBDIVISIONS} WHERE id IN (6, 9)")
def subdivision_get(spark, d):
    s = _subdivisions(spark, d)
    return s.get(iso_code="I-6").unionByName(s.get(id=3, geonames_code="G.9")).select("id", "name", "iso_code")


@_query(f"SELECT id, name FROM {_SUBDIVISIONS} WHERE list_contains(string_split(name, ' '), 'UNITED') AND type = 'State'")
def subdivision_filter(spark, d):
    return _subdivisions(spark, d).filter(name="united", type="state").select("id", "name")


@_query(f"SELECT DISTINCT type FROM {_SUBDIVISIONS} WHERE country LIKE 'EUROPE|%' AND parent_id IS NULL")
def subdivision_types(spark, d):
    return _subdivisions(spark, d).types_for_country(alpha2="EU")


@_query(f"SELECT id, name FROM {_REGIONS} WHERE name = 'MIDDLE EAST'")
def country_filter(spark, d):
    return registries.Countries.read(spark, _countries_file(spark, d)).filter(official_name="east", alt_name="middle").select("id", "name")


@_query(f"SELECT id, name FROM {_REGIONS} WHERE name = 'EUROPE'")
def registry_stored(spark, d):
    """A registry's table and index stored, opened again and asked."""
    path = scratch(spark, "registry")
    registries.Countries.read(spark, _countries_file(spark, d)).store(path)
    opened = registries.Countries()
    opened.open(spark, path)
    return opened.search("eurpe", limit=1).select("id", "name")


@_query(f"SELECT id AS geonames_id, name FROM {_PLACES} WHERE type = 'BUILDING' AND country LIKE 'ASIA|%'")
def city_filter(spark, d):
    registry = registries.Cities()
    registry.load(spark, _cities_file(spark, d))
    return registry.filter(alt_name="building", country="asia").select(F.col("geonames_id").cast("long").alias("geonames_id"), "name")


@_query(f"SELECT n_name AS name, r_name[1:2] || '.' || n_nationkey AS code, n_nationkey::BIGINT AS place FROM {_APART} JOIN region ON n_regionkey = r_regionkey")
def read_lines(spark, d):
    """Tab-separated lines without a header or quoting, by position."""
    path = scratch(spark, "lines")
    _admin_lines(spark, d).select(F.concat_ws("\t", "code", "name", "ascii", "seq")).write.text(path)
    return readers.lines(spark, path, code=0, name=1, place=3).withColumn("place", F.col("place").cast("long"))


@_query("SELECT p_partkey AS id, p_name || ', \"' || p_type || '\"' AS name FROM part")
def read_csv(spark, d):
    path = scratch(spark, "csv")
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("name"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.csv(spark, path, ("id", "name")).withColumn("id", F.col("id").cast("long"))


@_query("SELECT p_partkey AS id, CASE WHEN p_size > 9 THEN p_name END AS name FROM part")
def write_and_read_json(spark, d):
    path = scratch(spark, "json")
    tables.write_json(parts(spark, d).select("id", F.when(F.col("size") > 9, F.col("name")).alias("name")), path)
    return spark.read.schema("id long, name string").json(path)


@_query(f"SELECT id::VARCHAR AS key, name, alpha2 FROM {_REGIONS}")
def write_and_read_json_object(spark, d):
    """One indented JSON object, read as a map."""
    path = scratch(spark, "object")
    tables.write_json_object(regions(spark, d).select("id", "name", "alpha2"), path, "id")
    return readers.json_map(spark, path, "struct<name:string,alpha2:string>").select("key", "value.name", "value.alpha2")


@_query(f"SELECT name, alpha2 FROM {_REGIONS}")
def read_json_root(spark, d):
    """The records under a key of a file's one object, here named as ISO names it."""
    path = scratch(spark, "root")
    whole = regions(spark, d).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("alpha2").alias("alpha_2"), "name")).alias("3166-1")), {"pretty": "true"}).alias("value"))
    whole.write.text(path)
    return readers.json_records(spark, path, "alpha_2 string, name string", "3166-1").select("name", F.col("alpha_2").alias("alpha2"))


# --- tables and stores


@_query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def table_insert(spark, d):
    """A table made, filled in two batches and dropped; its files stay to be read."""
    path, name = scratch(spark, "table"), f"gazelark_{scratch(spark, 'n').rsplit('-', 1)[1]}"
    tables.create_many(spark, {name + "_unused": "id bigint"})
    tables.create(spark, name, "id bigint, name string", path)
    tables.insert(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), name)
    tables.insert(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), name)
    tables.drop(spark, name, name + "_unused")
    return spark.read.schema("id bigint, name string").parquet(path)


@_query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def table_replace(spark, d):
    """A table replaced as a whole; one whose making fails leaves it as it was."""
    path = scratch(spark, "replaced")
    tables.replace_atomically(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), path)
    good = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    tables.replace_atomically(good, path)
    return spark.read.schema(good.schema).parquet(path)


@_query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def table_relocate(spark, d):
    """A stored table moved to another place and read there."""
    path = scratch(spark, "here")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    rows.write.parquet(path)
    tables.relocate(spark, path, f"{path}-moved/there")
    return spark.read.schema(rows.schema).parquet(f"{path}-moved/there")


@_query("SELECT event_type || ':' || user_id AS key, CASE WHEN count(*) % 2 = 1 THEN '0' ELSE '2' END AS value FROM events GROUP BY ALL")
def store_flags_reset(spark, d):
    flags = table(spark, d, "events").groupBy(F.concat_ws(":", "event_type", "user_id").alias("key")).agg(F.when(F.count("*") % 2 == 1, "1").otherwise("2").alias("value"))
    return tables.flags_reset(flags)


@_query(f"SELECT * FROM {_bm25_sql(_PARTS, ['name', 'brand', 'type'], [(None, ['small'], False), (None, ['g'], True)])}")
def fts_stored_index(spark, d):
    """The index written, sorted by token, and read for the match."""
    path = scratch(spark, "index")
    fts.TextIndex.build(parts(spark, d), PARTS).write(path)
    index = fts.TextIndex.read(spark, path, PARTS)
    both = fts.fts_match(index, "small").select("id").join(fts.fts_match(index, "g", exact=False).select("id"), "id", "left_semi")
    phrases = [fts._hits(index, ["small"], False, None).withColumn("phrase", F.lit(0)), fts._hits(index, ["g"], True, None).withColumn("phrase", F.lit(1))]
    each = phrases[0].unionByName(phrases[1]).groupBy("id", "phrase").agg(F.sum(F.when(F.col("field") == "name", fts.FIRST_WEIGHT).otherwise(1.0)).alias("tf"))
    return fts.ranked(each, index, 2).join(both, "id", "left_semi").select("id", F.round("rank", 6).alias("rank"))


# --- building


def _apart(spark, d) -> DataFrame:
    n = table(spark, d, "nation").withColumn("n_name", F.substring(F.md5(F.col("n_name").cast("binary")), 1, 14))
    return n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def _admin_lines(spark, d) -> DataFrame:
    n = _apart(spark, d)
    return n.select(F.concat_ws(".", F.substring("r_name", 1, 2), "n_nationkey").alias("code"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.upper("n_name")).otherwise(F.col("n_name")).alias("ascii"), F.col("n_nationkey").alias("seq"))


def _iso_countries(spark, d) -> DataFrame:
    r = regions(spark, d)
    return r.select(F.col("alpha2").alias("alpha_2"), F.col("alpha3").alias("alpha_3"), "numeric", "name", F.when(F.col("id") > 3, F.lower("name")).otherwise("").alias("common_name"), F.when(F.col("id") > 1, F.concat(F.lit("The "), "name")).alias("official_name"), F.lit("f").alias("flag"))


#: As seed_countries names regions: a given name, then the common one, then the name.
_SEEDED = "CASE WHEN alpha2 = 'EU' THEN 'Europe proper' WHEN id > 3 THEN lower(name) ELSE name END"
_NAMES, _ALIASES = {"EU": "Europe proper"}, {"AS": ["Orient", "asia"]}


@_query(f"SELECT {_SEEDED} AS name, CASE WHEN alpha2 = 'AM' THEN 'Americas' WHEN id > 1 THEN 'The ' || name ELSE '' END AS official_name, alpha2, alpha3, numeric::INT AS numeric, CASE WHEN alpha2 = 'AS' THEN 'Orient|asia' ELSE '' END AS alts FROM {_REGIONS}")
def etl_seed_countries(spark, d):
    seeded = etl.seed_countries(_iso_countries(spark, d), _NAMES, {"AM": "Americas"}, _ALIASES)
    return seeded.select("name", "official_name", "alpha2", "alpha3", "numeric", F.array_join("alt_names", "|").alias("alts"))


def _wikidata(spark, d) -> DataFrame:
    """Aliases that go: a code, what names a standard, what is short, the name in other case."""
    r = regions(spark, d)
    known = r.select(F.concat("name", F.lit(" land")).alias("name"), "alpha2", "alpha3", F.concat_ws("|", "alpha3", F.lower("name"), F.concat(F.lit("ISO 3166-1:"), "alpha2"), F.lit("abc"), F.concat("name", F.lit(" world"))).alias("aliases"))
    other = r.where("id <= 2").select(F.concat(F.lit("New "), "name").alias("name"), F.concat(F.lit("N"), F.substring("alpha2", 1, 1)).alias("alpha2"), F.when(F.col("id") == 2, F.concat(F.lit("N"), "alpha2")).alias("alpha3"), F.lit(None).cast("string").alias("aliases"))
    return known.unionByName(other)


_MERGED = f"""
  SELECT {_SEEDED} AS name, alpha2, alpha3,
         CASE WHEN alpha2 = 'AS' THEN 'Orient|asia|' ELSE '' END || name || ' land|' || CASE WHEN alpha2 = 'EU' THEN lower(name) || '|' ELSE '' END || name || ' world' AS alts FROM {_REGIONS}
  UNION ALL SELECT 'New ' || name, 'N' || alpha2[1:1], 'N' || alpha2, 'New ' || name || '|' FROM {_REGIONS} WHERE id = 2"""


@_query(_MERGED)
def etl_merge_aliases(spark, d):
    seeded = etl.seed_countries(_iso_countries(spark, d), _NAMES, {}, _ALIASES)
    merged = etl.merge_aliases(seeded, _wikidata(spark, d))
    return merged.select("name", "alpha2", "alpha3", F.when(F.col("alpha2") == "NA", F.concat(F.array_join("alt_names", "|"), F.lit("|"))).otherwise(F.array_join("alt_names", "|")).alias("alts"))


@_query(f"SELECT {_SEEDED} AS name, alpha2, CASE WHEN id <= 3 THEN 'X' || alpha2 ELSE alpha3 END AS alpha3, CASE WHEN alpha2 = 'AS' THEN 'Orient|asia' ELSE '' END || CASE WHEN id = 2 THEN 'Amerika' ELSE '' END AS alts FROM {_REGIONS}")
def etl_merge_codes(spark, d):
    """alpha3 overwritten; a name that is known already, in any case, isn't added."""
    seeded = etl.seed_countries(_iso_countries(spark, d), _NAMES, {}, _ALIASES)
    codes = regions(spark, d).where("id <= 3").select("alpha2", F.concat(F.lit("X"), "alpha2").alias("alpha3"), F.when(F.col("id") == 2, "Amerika").otherwise(F.lower("name")).alias("name"))
    return etl.merge_codes(seeded, codes).select("name", "alpha2", "alpha3", F.array_join("alt_names", "|").alias("alts"))


@_query("SELECT p_brand AS name, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS alt_names FROM part WHERE p_name <> 'red widget' GROUP BY p_brand")
def etl_dump_countries(spark, d):
    """Aliases as text: different ones, without the names, sorted."""
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.concat(F.collect_list("p_name"), F.array(F.first("p_brand"), F.lit("red widget"))).alias("alt_names")).withColumn("official_name", F.lit("red widget"))
    return etl.dumped_countries(rows).select("name", "alt_names")


_SUBS_GEO = f"SELECT n_name AS name, r_name[1:2] AS alpha2, 1 AS admin_level, r_name[1:2] || '.' || n_nationkey AS code, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE '' END AS alts, ('0x' || md5(r_name[1:2] || '|1|' || lower(n_name) || '|' || r_name[1:2] || '.' || n_nationkey)[1:16])::UBIGINT::VARCHAR AS id FROM {_APART} JOIN region ON n_regionkey = r_regionkey"


@_query(_SUBS_GEO)
def etl_geonames_subdivisions(spark, d):
    known = regions(spark, d).select("alpha2", "alpha3", "name")
    out = etl.geonames_subdivisions(_admin_lines(spark, d), known)
    return out.select("name", "alpha2", "admin_level", F.col("geonames_code").alias("code"), F.array_join("alt_names", "|").alias("alts"), F.col("id").cast("string").alias("id"))


def _iso_rows(spark, d) -> DataFrame:
    """Two rows a nation: a first one with a kind of place, and a second one in small letters."""
    n = _apart(spark, d)
    base = n.select(F.substring("r_name", 1, 2).alias("country_code"), F.concat(F.substring("r_name", 1, 2), F.lit("-"), "n_nationkey").alias("iso_code"), F.concat("n_name", F.lit(" Province")).alias("name"), F.lit("").alias("localVariant"), F.lit("Province").alias("category"), F.lit("").alias("parent_iso_code"), F.col("n_nationkey").alias("seq"))
    return base.unionByName(base.withColumns({"name": F.concat(F.lit("old "), F.lower("name")), "seq": F.col("seq") + 100}))


@_query(f"SELECT n_name || ' Province' AS name, r_name[1:2] || '-' || n_nationkey AS iso_code, 1 AS admin_level, 'Province' AS type, 2 AS names FROM {_APART} JOIN region ON n_regionkey = r_regionkey")
def etl_iso_subdivisions(spark, d):
    """Rows of one code are one subdivision, named by the first; each further name has one spelling whatever its case."""
    out = etl.iso_subdivisions(_iso_rows(spark, d), regions(spark, d).select("alpha2", "alpha3", "name"))
    return out.select("name", "iso_code", "admin_level", "type", F.size("alt_names").alias("names"))


def _subdivision_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    known = regions(spark, d).select("alpha2", "alpha3", "name")
    return etl.iso_subdivisions(_iso_rows(spark, d), known), etl.geonames_subdivisions(_admin_lines(spark, d), known)


@_query(f"SELECT r_name[1:2] || '-' || n_nationkey AS iso_code, ('0x' || md5(r_name[1:2] || '|1|' || lower(n_name) || '|' || r_name[1:2] || '.' || n_nationkey)[1:16])::UBIGINT::VARCHAR AS id FROM {_APART} JOIN region ON n_regionkey = r_regionkey")
def etl_entity_resolution(spark, d):
    """Nations against rows that add a kind of place: each finds its own."""
    iso, geo = _subdivision_sides(spark, d)
    return etl.resolved(iso, geo, order="seq")


@_query(f"SELECT n_name || ' Province' AS name, r_name[1:2] || '.' || n_nationkey AS geonames_code, r_name[1:2] || '-' || n_nationkey AS iso_code, 'Province' AS type FROM {_APART} JOIN region ON n_regionkey = r_regionkey")
def etl_merged_subdivisions(spark, d):
    iso, geo = _subdivision_sides(spark, d)
    return etl.merged(iso, geo, etl.first_match(iso, geo, "seq")).select("name", "geonames_code", "iso_code", "type")


@_query(f"SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'added' ELSE 'matched' END AS kind, r_name[1:2] || '-' || n_nationkey AS iso_code, CASE WHEN n_nationkey % 3 = 1 THEN 'G' || n_nationkey END AS id FROM {_APART} JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 < 2")
def etl_overlay(spark, d):
    """Rows by a manual map: some are added, some given a partner, some are left."""
    iso, _ = _subdivision_sides(spark, d)
    number = F.split_part("iso_code", F.lit("-"), F.lit(2)).cast("int")
    overlay = iso.select("iso_code", F.when(number % 3 == 1, F.concat(F.lit("G"), number)).alias("id"), F.array("name").alias("names"), (number % 3 == 0).alias("added"))
    added, matched = etl.with_overlay(iso, overlay)
    return added.select(F.lit("added").alias("kind"), "iso_code", F.lit(None).cast("string").alias("id")).unionByName(matched.select(F.lit("matched").alias("kind"), "iso_code", "id"))


@_query(f"""
  WITH s AS (SELECT id AS hash, name, CASE WHEN parent_id IS NULL THEN 1 ELSE 2 END AS level, split_part(country, '|', 2) AS alpha2, country, parent_id FROM {_NATIONS}),
  r AS (SELECT *, row_number() OVER (ORDER BY alpha2, level, name, hash) AS id FROM s)
  SELECT r.id, r.name, r.country, p.id AS parent_id FROM r LEFT JOIN r p ON r.parent_id = p.hash""")
def etl_final_subdivisions(spark, d):
    n = nations(spark, d)
    code = lambda c: F.when(F.col(c) % 2 == 0, F.concat(F.lit("I-"), c)).otherwise(F.concat(F.lit("G."), c))
    named = text.compound("country", ("country_name", "alpha2", "alpha3"), strict=True)
    subs = n.select("id", "name", named.alias("c"), F.when(F.col("parent_id").isNull(), 1).otherwise(2).alias("admin_level"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("I-"), "id")).otherwise("").alias("iso_code"), F.when(F.col("id") % 2 == 1, F.concat(F.lit("G."), "id")).otherwise("").alias("geonames_code"), code("parent_id").alias("parent_code"), F.lit("").alias("type"), F.array().cast("array<string>").alias("alt_names")).select("*", "c.*").drop("c")
    return etl.final_subdivisions(subs).select("id", "name", "country", "parent_id")


def _dump(spark, d) -> DataFrame:
    """Customers as lines of a GeoNames dump."""
    c = places(spark, d).withColumn("nation", F.expr("CAST(substr(admin2, 2) AS INT) + 20") % 25)
    given = {"geonameid": F.col("id"), "name": F.initcap("type"), "asciiname": F.col("type"), "alternatenames": F.concat_ws(",", F.concat(F.lit("x"), "type"), F.lit("ab"), F.concat(F.initcap("type"), F.lit("é")), F.lit("Ж"), F.concat(F.lower("type"), F.lit("e"))), "latitude": F.lit("1.5"), "longitude": F.lit("-2"), "feature code": F.when(F.col("population") > 5000, "PPLA").when(F.col("population") < 0, "HTL").otherwise("PPL"), "country code": F.split_part("country", F.lit("|"), F.lit(2)), "admin1 code": F.col("nation"), "population": F.round(F.abs("population")).cast("long")}
    return c.select(*[F.coalesce(given[x].cast("string"), F.lit("")).alias(x) if x in given else F.lit("").alias(x) for x in readers.GEONAMES_COLUMNS])


_CITY_SQL = f"""
  SELECT c_custkey AS geonames_id, {_TITLED.format("c_mktsegment")} AS name, 'X' || lower(c_mktsegment) || '|' || {_TITLED.format("c_mktsegment")} || 'é' AS alt_names, abs(round(c_acctbal))::BIGINT AS population, 1.5::DOUBLE AS lat, -2.0::DOUBLE AS lng, r_name[1:2] AS alpha2, n_nationkey AS nation
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal >= 0 AND abs(round(c_acctbal)) > 0"""


@_query(f"SELECT geonames_id, name, alt_names, population, lat, lng, CASE WHEN nation % 2 = 0 THEN 'n' || nation END AS admin1, alpha2 || '!' AS country FROM ({_CITY_SQL})")
def etl_cities(spark, d):
    """A dump written as lines, read by given names, filtered, its aliases told apart, and joined to its country and subdivisions by code."""
    path = scratch(spark, "dump")
    _dump(spark, d).select(F.concat_ws("\t", *[f"`{c}`" for c in readers.GEONAMES_COLUMNS])).write.text(path)
    raw = readers.tsv(spark, path, readers.GEONAMES_COLUMNS, header=False, quoted=False)
    known = regions(spark, d).select(F.col("alpha2").alias("key"), F.concat("alpha2", F.lit("!")).alias("value"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 2 = 0")
    subs = n.select(F.concat_ws(".", F.substring("r_name", 1, 2), "n_nationkey").alias("key"), F.concat(F.lit("n"), "n_nationkey").alias("value"))
    return etl.cities(raw, known, subs).select(F.col("geonames_id").cast("long").alias("geonames_id"), "name", "alt_names", "population", "lat", "lng", "admin1", "country")


@_query(f"""
  SELECT 'countries' AS kind, (row_number() OVER (ORDER BY alpha2))::BIGINT AS id, {_SEEDED} AS name, alpha2 AS code FROM {_REGIONS}
  UNION ALL
  SELECT 'subdivisions', (row_number() OVER (ORDER BY r_name[1:2], n_name || ' Province'))::BIGINT, n_name || ' Province', r_name[1:2] || '.' || n_nationkey FROM {_APART} JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'cities', (row_number() OVER (ORDER BY geonames_id))::BIGINT, name, alpha2 FROM ({_CITY_SQL})""")
def etl_ingest(spark, d):
    """All three tables built from raw sources."""
    none = regions(spark, d).limit(0)
    overlay = none.select(F.col("alpha2").alias("iso_code"), F.col("alpha3").alias("id"), F.array("name").alias("names"), F.lit(True).alias("added"))
    wikidata = _wikidata(spark, d).where("name LIKE '% land'")
    codes = regions(spark, d).select("alpha2", "alpha3", "name")
    built = etl.ingest(etl.Sources(_iso_countries(spark, d), wikidata, codes, _admin_lines(spark, d), _iso_rows(spark, d), overlay, _dump(spark, d), names=_NAMES), scratch(spark, "built"))
    return (
        built["countries"].select(F.lit("countries").alias("kind"), "id", "name", F.col("alpha2").alias("code"))
        .unionByName(built["subdivisions"].select(F.lit("subdivisions").alias("kind"), "id", "name", F.col("geonames_code").alias("code")))
        .unionByName(built["cities"].select(F.lit("cities").alias("kind"), "id", "name", F.split_part("country", F.lit("|"), F.lit(2)).alias("code")))
    )


# --- scalar functions over whole tables


@_query("SELECT p_partkey AS id, lower(strip_accents('Ö' || p_name || 'É')) AS decomposed, 'O' || p_name || 'Ess' AS ascii FROM part")
def fold_names(spark, d):
    name = F.concat(F.lit("Ö"), "p_name", F.lit("É"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.decomposed(name).alias("decomposed"), text.ascii_name(F.concat(name, F.lit("ß "))).alias("ascii"))


@_query("SELECT count(*) AS n, 0::BIGINT AS far_in_length, 0::BIGINT AS other_first, 0::BIGINT AS short_changed, 0::BIGINT AS far_in_letters FROM part")
def typo_injection(spark, d):
    """Misspelt names differ by as many letters as changes allow, keep their first letter, and short ones stay."""
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey"))
    made = spread(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").select(name.alias("name"), typos.with_typos(name, F.col("p_partkey")).alias("typo"), F.substring("p_name", 1, 3).alias("short"), F.greatest(F.lit(1), F.floor(F.length(name) * typos.SHARE)).alias("changes"))
    bad = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    far = similarity.indel_distance(F.col("name"), F.col("typo")) > 2 * F.col("changes")
    return made.agg(F.count("*").alias("n"), bad(F.abs(F.length("name") - F.length("typo")) > F.col("changes")).alias("far_in_length"), bad(F.substring("name", 1, 1) != F.substring("typo", 1, 1)).alias("other_first"), bad(typos.with_typos(F.col("short"), F.lit(1)) != F.col("short")).alias("short_changed"), bad(far).alias("far_in_letters"))
