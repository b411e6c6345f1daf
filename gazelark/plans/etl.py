"""Building the entity tables from raw sources, as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import _let, token_set_ratio
from ..functions.text import ascii_name, comparable, decomposed, deduped, directions_differ, hash_id, is_latin, join_bar, match_threshold, titled
from ..operators.lookup import with_ids
from ..session import spread
from ..sources import tables

# The feature codes of populated places that count as cities.
CITY_CODES = ("PPL", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLA5", "PPLC", "PPLF", "PPLL", "PPLS", "STLMT")


def _mapped(table: dict, key: str, value_type: str) -> Column:
    if not table:
        return F.lit(None).cast(value_type)
    entries = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v))]
    return F.try_element_at(F.create_map(*entries), F.col(key))


def seed_countries(iso: DataFrame, names: dict[str, str], official: dict[str, str], aliases: dict[str, list[str]]) -> DataFrame:
    """Countries from ISO 3166-1 rows; a given name goes before a common one, that before the name."""
    return iso.select(
        F.coalesce(_mapped(names, "alpha_2", "string"), F.nullif("common_name", F.lit("")), "name").alias("name"),
        F.coalesce(_mapped(official, "alpha_2", "string"), "official_name", F.lit("")).alias("official_name"),
        F.col("alpha_2").alias("alpha2"),
        F.col("alpha_3").alias("alpha3"),
        F.col("numeric").cast("int").alias("numeric"),
        F.coalesce(_mapped(aliases, "alpha_2", "array<string>"), F.array().cast("array<string>")).alias("alt_names"),
        "flag",
    )


def _lowered(c: Column) -> Column:
    return F.transform(c, F.lower)


def merge_aliases(countries: DataFrame, rows: DataFrame) -> DataFrame:
    """Names and aliases of (name, alpha2, alpha3, aliases) rows added; rows without alpha3 are left out, unknown countries come in."""
    rows = rows.where(F.coalesce("alpha3", F.lit("")) != "").select(F.col("alpha2").alias("_a2"), F.col("alpha3").alias("_a3"), F.col("name").alias("_name"), F.split(F.coalesce("aliases", F.lit("")), r"\|").alias("_aliases"))
    both = countries.join(rows, F.col("alpha2") == F.col("_a2"), "full_outer")
    base = both.withColumns(
        {"name": F.coalesce("name", "_name"), "official_name": F.coalesce("official_name", F.lit("")), "alpha2": F.coalesce("alpha2", "_a2"), "alpha3": F.coalesce("alpha3", "_a3"), "alt_names": F.coalesce("alt_names", F.array().cast("array<string>")), "flag": F.coalesce("flag", F.lit(""))}
    )
    named = F.when((F.coalesce("_name", F.lit("")) != "") & ~F.array_contains(_lowered(F.col("alt_names")), F.lower("_name")), F.array("_name")).otherwise(F.array().cast("array<string>"))
    own = F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in ("alpha2", "alpha3", "name", "official_name", "numeric")])
    good = F.filter(F.coalesce("_aliases", F.array().cast("array<string>")), lambda x: ~F.contains(x, F.lit("ISO 3166")) & (F.length(x) > 3) & ~F.array_contains(own, F.lower(F.trim(x))))
    return base.withColumn("alt_names", F.concat("alt_names", named, good)).select(*countries.columns)


def merge_codes(countries: DataFrame, rows: DataFrame) -> DataFrame:
    """alpha3 overwritten and the name added where new, from (alpha2, alpha3, name) rows of known countries."""
    rows = rows.select(F.col("alpha2").alias("_a2"), F.col("alpha3").alias("_a3"), F.col("name").alias("_name"))
    known = F.concat(F.array(F.lower("name"), F.lower(F.coalesce("official_name", F.lit("")))), _lowered(F.col("alt_names")))
    fresh = (F.coalesce("_name", F.lit("")) != "") & ~F.array_contains(known, F.lower("_name"))
    both = countries.join(rows, F.col("alpha2") == F.col("_a2"), "left")
    return both.withColumn("alt_names", F.when(fresh, F.concat("alt_names", F.array("_name"))).otherwise(F.col("alt_names"))).withColumn("alpha3", F.coalesce("_a3", "alpha3")).select(*countries.columns)


def dumped_countries(countries: DataFrame) -> DataFrame:
    """alt_names as text: different ones without the names, sorted."""
    return countries.withColumn("alt_names", F.array_join(F.array_sort(F.array_except("alt_names", F.array("name", "official_name"))), "|"))


def parsed_codes(rows: DataFrame) -> DataFrame:
    """(code, ...) with alpha2, admin_level and parent_code from codes of two or three dotted parts."""
    parts = F.split("code", r"\.")
    return rows.withColumns({"alpha2": F.get(parts, 0), "admin_level": F.size(parts) - 1, "parent_code": F.when(F.size(parts) == 3, F.concat_ws(".", F.get(parts, 0), F.get(parts, 1)))}).where(F.size(parts).isin(2, 3))


def geonames_subdivisions(rows: DataFrame, countries: DataFrame) -> DataFrame:
    """Subdivisions from (code, name, ascii) rows of known countries, in one shape with ISO's."""
    known = countries.select(F.col("alpha2"), F.col("alpha3"), F.col("name").alias("country_name"))
    joined = parsed_codes(rows).join(known, "alpha2")
    aliases = F.when((F.col("ascii") != F.col("name")) & (F.col("ascii") != ""), F.array("ascii")).otherwise(F.array().cast("array<string>"))
    return _hashed(joined.select("name", "alpha2", "alpha3", "country_name", "admin_level", F.col("code").alias("geonames_code"), F.lit("").alias("iso_code"), F.lit("").alias("type"), aliases.alias("alt_names"), "parent_code", *(["seq"] if "seq" in rows.columns else [])))


def _hashed(df: DataFrame) -> DataFrame:
    code = F.when(F.col("iso_code") != "", F.col("iso_code")).otherwise(F.col("geonames_code"))
    return df.withColumn("id", hash_id("alpha2", "admin_level", F.lower(ascii_name("name")), code))


def iso_subdivisions(rows: DataFrame, countries: DataFrame) -> DataFrame:
    """Subdivisions from ISO 3166-2 rows (country_code, iso_code, name, localVariant, category, parent_iso_code, seq).

    The local variant is the name where there is one. Rows of one code are one subdivision, named by the first. An unknown country is an error.
    """
    known = countries.select(F.col("alpha2"), F.col("alpha3"), F.col("name").alias("country_name"))
    named = rows.withColumns({"own": F.coalesce(F.nullif("localVariant", F.lit("")), "name"), "other": F.when(F.coalesce("localVariant", F.lit("")) != "", F.col("name"))})
    joined = named.join(known, F.col("country_code") == F.col("alpha2"), "left").withColumn("alpha2", F.when(F.col("alpha2").isNotNull(), F.col("alpha2")).otherwise(F.raise_error(F.concat(F.lit("no country "), F.col("country_code"))).cast("string")))
    spelled = F.array_compact(F.array("own", "other", titled(ascii_name("own")), titled(ascii_name("other"))))
    grouped = joined.groupBy("iso_code").agg(
        F.min(F.struct("seq", "own", "alpha2", "alpha3", "country_name", "category", "parent_iso_code")).alias("f"),
        F.flatten(F.array_sort(F.collect_list(F.struct("seq", spelled.alias("s"))))["s"]).alias("spelled"),
    )
    parent = F.nullif("f.parent_iso_code", F.lit(""))
    aliases = F.filter(F.col("spelled"), lambda x: (x != F.col("f.own")) & (x != ""))
    out = grouped.select(F.col("f.own").alias("name"), "f.alpha2", "f.alpha3", "f.country_name", F.when(parent.isNull(), 1).otherwise(2).alias("admin_level"), F.lit("").alias("geonames_code"), "iso_code", F.col("f.category").alias("type"), deduped(F.array_distinct(aliases)).alias("alt_names"), parent.alias("parent_code"))
    return _hashed(out)


def first_match(iso: DataFrame, geo: DataFrame, order: str = "id") -> DataFrame:
    """(iso_code, id): for each ISO subdivision the first one by order of its country and level with a name that matches one of its own.

    The block join is by (country, level). Matches see the GeoNames rows as they were; see resolved() for the sequential order.
    """
    names = lambda: F.array_distinct(F.concat(F.array("name"), "alt_names"))
    left = iso.select("iso_code", "alpha2", "admin_level", F.explode(names()).alias("n")).select("iso_code", "alpha2", "admin_level", comparable("n").alias("a")).distinct()
    right = geo.select("id", F.col(order).alias("order"), "alpha2", "admin_level", F.explode(names()).alias("n")).select("id", "order", "alpha2", "admin_level", comparable("n").alias("b")).distinct()
    pairs = left.join(right, ["alpha2", "admin_level"])
    good = pairs.where((token_set_ratio(F.col("a"), F.col("b")) >= match_threshold("a", "b")) & ~directions_differ("a", "b"))
    return good.groupBy("iso_code").agg(F.min_by("id", "order").alias("id"))


def resolved(iso: DataFrame, geo: DataFrame, seq: str = "iso_code", order: str = "id") -> DataFrame:
    """Entity resolution in order: (iso_code, id of the row it merged with, or null), one group of country and level at a time.

    A merge adds the ISO row's names to the GeoNames row, and later ISO rows see them, so a group is walked: ISO rows in the order of
    seq, each against GeoNames rows in theirs, which for a file is its lines'. A group's size is bounded by the subdivisions of one level
    of one country.
    """

    def each(df: DataFrame, side: str, by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("alpha2", "admin_level").orderBy(by))
        return df.select("alpha2", "admin_level", F.lit(side).alias("side"), place.alias("place"), F.col("id").cast("string").alias("id"), "iso_code", F.concat(F.array("name"), "alt_names").alias("names"))

    both = each(iso, "iso", seq).unionByName(each(geo, "geo", order))
    # the names as they are compared, worked out in Spark
    ready = both.withColumn("names", F.transform("names", comparable))
    return ready.groupBy("alpha2", "admin_level").applyInPandas(_walk, "iso_code string, id string")


def _walk(group):
    import pandas as pd

    geo = [(r.id, list(r.names)) for r in group[group.side == "geo"].sort_values("place").itertuples()]
    out = []
    for r in group[group.side == "iso"].sort_values("place").itertuples():
        hit = next((g for g in geo if any(_same(a, b) for a in r.names for b in g[1])), None)
        if hit:
            hit[1].extend(n for n in r.names if n not in hit[1])
        out.append((r.iso_code, hit[0] if hit else None))
    return pd.DataFrame(out, columns=["iso_code", "id"])


def _same(a: str, b: str) -> bool:
    from ..functions.text import DIRECTIONS

    x, y = set(a.split()), set(b.split())
    if not x or not y or any(d in x ^ y for d in DIRECTIONS):
        return False
    mean = (len(a) + len(b)) / 2
    need = 90 - (15 if mean <= 5 else 10 if mean <= 8 else 5 if mean <= 12 else 0) - (5 if max(len(a.split()), len(b.split())) == 1 else 0)
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not left or not right):
        return True
    n, la, lb, gap = len(common), len(left), len(right), 1 if common else 0
    row = [0] * (lb + 1)
    for c in left:
        before = 0
        for j, d in enumerate(right):
            before, row[j + 1] = row[j + 1], max(row[j + 1], row[j], before + (c == d))
    best = [1 - (la + lb - 2 * row[-1]) / (2 * (n + gap) + la + lb)]
    if common:
        best += [1 - (gap + z) / (2 * n + gap + z) for z in (la, lb)]
    return 100 * max(best) >= need


def merged(iso: DataFrame, geo: DataFrame, matches: DataFrame) -> DataFrame:
    """GeoNames subdivisions with their matched ISO ones merged in: ISO's name, code and type count, the other names are aliases."""
    i = iso.join(matches, "iso_code").groupBy(F.col("id").cast("string").alias("_id")) if "id" not in iso.columns else iso.drop("id").join(matches, "iso_code").groupBy(F.col("id").cast("string").alias("_id"))
    i = i.agg(F.max(F.struct("iso_code", "name", "type")).alias("m"), F.flatten(F.collect_list(F.concat("alt_names", F.array("name")))).alias("more"))
    both = geo.join(i, F.col("id").cast("string") == F.col("_id"), "left")
    name = F.coalesce("m.name", "name")
    aliases = F.when(F.col("_id").isNotNull(), deduped(F.filter(F.concat("alt_names", F.array("name"), "more"), lambda x: x != name))).otherwise(F.col("alt_names"))
    return both.select(name.alias("name"), *[c for c in geo.columns if c not in ("name", "iso_code", "type", "alt_names")], F.coalesce("m.iso_code", "iso_code").alias("iso_code"), F.coalesce("m.type", "type").alias("type"), aliases.alias("alt_names"))


def with_overlay(iso: DataFrame, overlay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unmatched ISO rows by a manual map (iso_code, id, names, added): (rows to add as they are, (iso_code, id) matches); names are added."""
    o = overlay.select("iso_code", F.col("id").alias("_to"), "names", "added")
    both = iso.join(o, "iso_code").withColumn("alt_names", F.concat("alt_names", F.coalesce("names", F.array().cast("array<string>"))))
    return both.where("added").select(*iso.columns), both.where("NOT added AND _to IS NOT NULL").select("iso_code", F.col("_to").alias("id"))


def final_subdivisions(subs: DataFrame) -> DataFrame:
    """Rows numbered in order of country, level and name, with parents by number and compounds as text.

    A parent's code is an ISO code if it has a hyphen, a GeoNames code if it has a dot.
    """
    ranked = with_ids(subs.withColumnRenamed("id", "hash"), "alpha2", "admin_level", "name", "hash")
    up = F.col("parent_code")
    by_iso = ranked.where("iso_code <> ''").groupBy(F.col("iso_code").alias("_iso")).agg(F.min("id").alias("_p1"))
    by_geo = ranked.where("geonames_code <> ''").groupBy(F.col("geonames_code").alias("_geo")).agg(F.min("id").alias("_p2"))
    out = ranked.join(by_iso, F.contains(up, F.lit("-")) & (up == F.col("_iso")), "left").join(by_geo, F.contains(up, F.lit(".")) & (up == F.col("_geo")), "left")
    return out.select("id", "name", F.array_join("alt_names", "|").alias("alt_names"), "geonames_code", "iso_code", join_bar("country_name", "alpha2", "alpha3").alias("country"), "type", F.coalesce("_p1", "_p2").alias("parent_id"))


def is_city(code: str = "feature code", population: str = "population") -> Column:
    return F.col(f"`{code}`").isin(*CITY_CODES) & ~F.coalesce(F.col(population), F.lit("")).isin("", "0")


def city_aliases(name: Column, alternates: Column, ascii: Column) -> Column:
    """Latin aliases of three letters or more, the first of each spelling once case and marks are off, without the name's own; titled."""
    every = F.transform(F.concat(F.when(F.coalesce(alternates, F.lit("")) != "", F.split(alternates, ",")).otherwise(F.array().cast("array<string>")), F.array(ascii)), lambda x: F.trim(x))
    good = F.filter(every, lambda x: (F.length(x) >= 3) & is_latin(x))
    keyed = F.transform(good, lambda x: F.struct(decomposed(x).alias("k"), x.alias("v")))

    def first(fresh: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(fresh, lambda x: x["k"])), lambda k: titled(F.get(F.filter(fresh, lambda x: x["k"] == k), 0)["v"]))

    # each step is named once: an expression that stands in a lambda is worked out anew for each value
    both = F.struct(keyed.alias("keyed"), decomposed(name).alias("own"))
    return _let(both, lambda s: _let(F.filter(s["keyed"], lambda x: x["k"] != s["own"]), first))


def cities(raw: DataFrame, countries: DataFrame, subdivisions: DataFrame) -> DataFrame:
    """City rows of a GeoNames dump with their country and subdivisions by code, null where unknown.

    countries and subdivisions are (key, value) tables; Spark broadcasts them only if they are small.
    """
    rows = spread(raw.where(is_city()), "geonameid")
    keyed = rows.withColumns({"_c": F.col("`country code`"), "_1": F.concat_ws(".", "country code", F.coalesce("admin1 code", F.lit(""))), "_2": F.concat_ws(".", "country code", F.coalesce("admin1 code", F.lit("")), F.coalesce("admin2 code", F.lit("")))})
    named = lambda t, k, v: t.select(F.col("key").alias(k), F.col("value").alias(v))
    out = keyed.join(named(countries, "_c", "country"), "_c", "left").join(named(subdivisions, "_1", "admin1"), "_1", "left").join(named(subdivisions, "_2", "admin2"), "_2", "left")
    return out.select(F.col("geonameid").alias("geonames_id"), "name", F.array_join(city_aliases(F.col("name"), F.col("alternatenames"), F.col("asciiname")), "|").alias("alt_names"), "admin1", "admin2", "country", F.col("population").cast("bigint").alias("population"), F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lng"))


@dataclass
class Sources:
    """What the entity tables are built from, as the readers give it; seq columns count lines."""

    iso: DataFrame  # ISO 3166-1: alpha_2, alpha_3, numeric, name, common_name, official_name, flag
    wikidata: DataFrame  # name, alpha2, alpha3, aliases
    codes: DataFrame  # GeoNames countries: alpha2, alpha3, name
    admin: DataFrame  # GeoNames admin1 and admin2: code, name, ascii, seq
    iso_subdivisions: DataFrame  # ISO 3166-2: country_code, iso_code, name, localVariant, category, parent_iso_code, seq
    overlay: DataFrame  # iso_code, id, names, added
    cities: DataFrame  # a GeoNames dump
    names: dict[str, str] = field(default_factory=dict)
    official: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, list[str]] = field(default_factory=dict)


def ingest(sources: Sources, path: str) -> dict[str, DataFrame]:
    """Build countries, subdivisions and cities, each replaced as a whole under path; returns them by name.

    A step reads what the one before has written, so an error leaves the tables after it as they were.
    """
    spark = sources.iso.sparkSession

    def put(name: str, df: DataFrame) -> DataFrame:
        tables.replace_atomically(df, f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    merged_countries = merge_codes(merge_aliases(seed_countries(sources.iso, sources.names, sources.official, sources.aliases), sources.wikidata), sources.codes)
    countries = put("countries", with_ids(dumped_countries(merged_countries), "alpha2"))
    geo = put("work/geonames", geonames_subdivisions(sources.admin, countries))
    iso = put("work/iso", iso_subdivisions(sources.iso_subdivisions, countries))
    matches = put("work/matches", resolved(iso, geo, order="seq"))
    added, manual = with_overlay(iso.join(matches.where("id IS NULL").select("iso_code"), "iso_code"), sources.overlay)
    every = matches.where("id IS NOT NULL").unionByName(manual.withColumn("id", F.col("id").cast("string")))
    whole = merged(iso, geo, every).drop("seq").unionByName(added.select(*[c for c in geo.columns if c != "seq"]))
    subdivisions = put("subdivisions", final_subdivisions(whole))
    by_code = countries.select(F.col("alpha2").alias("key"), join_bar("name", "alpha2", "alpha3").alias("value"))
    by_geonames = subdivisions.where("geonames_code <> ''").select(F.col("geonames_code").alias("key"), join_bar("name", "geonames_code", "iso_code").alias("value"))
    # written first, as the ranges of the ids are drawn from a sample and then cut, which would build every city twice
    built = put("work/cities", cities(sources.cities, by_code, by_geonames))
    return {"countries": countries, "subdivisions": subdivisions, "cities": put("cities", with_ids(built.withColumn("_n", F.col("geonames_id").cast("bigint")), "_n").drop("_n"))}
