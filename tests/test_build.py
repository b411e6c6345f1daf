"""Readers, writers, key-value stores and the building of entity tables."""

import decimal
import json

import pytest
from pyspark.sql import functions as F

from gazelark.plans import etl
from gazelark.plans.registries import Cities, Countries
from gazelark.sources import readers, tables


def test_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_text("name\tofficial_name\talpha2\talpha3\tnumeric\talt_names\tflag\nAndorra\t \tAD\tAND\t20\t\tf\n\"A \"\"q\"\"\"\tX\tAA\tAAA\t4\ta|b\tg\n", encoding="utf-8")
    df = readers.tsv(spark, str(path), readers.COUNTRY_COLUMNS)
    rows = df.collect()
    assert rows[0]["official_name"] is None and rows[0]["alt_names"] is None and rows[1]["name"] == 'A "q"'
    tables.write_tsv(df, str(tmp_path / "out"), readers.COUNTRY_COLUMNS)
    assert readers.tsv(spark, str(tmp_path / "out"), readers.COUNTRY_COLUMNS).collect() == rows
    registry = Countries.read(spark, str(path))
    assert [(r["id"], r["alpha2"]) for r in registry.table.orderBy("id").collect()] == [(1, "AD"), (2, "AA")]
    with pytest.raises(Exception):
        readers.tsv(spark, str(path), ("a", "b", "c", "d", "e", "f", "g")).collect()


def test_other_readers(spark, tmp_path):
    (tmp_path / "l.txt").write_text('US.CA\tCalifornia "x\tCalif\t1\nUS.NY\tNew York\tNew York\t2\n')
    assert [tuple(r) for r in readers.lines(spark, str(tmp_path / "l.txt"), code=0, name=1, ascii=2).collect()] == [("US.CA", 'California "x', "Calif"), ("US.NY", "New York", "New York")]
    (tmp_path / "r.json").write_text(json.dumps({"3166-1": [{"alpha_2": "AD", "name": "Andorra"}, {"alpha_2": "AE", "name": "U"}]}))
    assert readers.json_records(spark, str(tmp_path / "r.json"), "alpha_2 string, name string", "3166-1").count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"X-1": {"id": 5, "names": ["n"], "added": False}}, indent=2))
    assert readers.json_map(spark, str(tmp_path / "m.json"), "struct<id:bigint,names:array<string>,added:boolean>").select("key", "value.id").collect()[0][1] == 5
    (tmp_path / "c.csv").write_text('country_code,name\nAD,"a, ""b"""\n')
    assert readers.csv(spark, str(tmp_path / "c.csv"), ("country_code", "name")).first()["name"] == 'a, "b"'
    table = readers.lookup_table(spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "k string, v string, n int"), "k", F.col("v"), "n")
    assert table.first()["value"] == "y"


def test_stores(spark, tmp_path):
    store = spark.createDataFrame([("a", "1", 0), ("b", "2", 0)], "key string, value string, seq int")
    changes = spark.createDataFrame([("a", "3", 1), ("a", "4", 2), ("c", "5", 1)], store.schema)
    assert {r["key"]: r["value"] for r in tables.upserted(store, changes).collect()} == {"a": "4", "b": "2", "c": "5"}
    assert {r["value"] for r in tables.flags_reset(store).collect()} == {"0", "2"}
    path = str(tmp_path / "t")
    tables.replace_atomically(store, path)
    tables.replace_atomically(changes, path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        tables.replace_atomically(store.withColumn("value", F.raise_error(F.lit("no"))), path)
    assert spark.read.parquet(path).count() == 3


COUNTRY = "name string, official_name string, alpha2 string, alpha3 string, numeric int, alt_names array<string>, flag string"


def test_country_steps(spark):
    iso = spark.createDataFrame([("AD", "AND", "020", "Andorra", None, "Principality of Andorra", "f"), ("VN", "VNM", "704", "Viet Nam x", "", None, "g")], "alpha_2 string, alpha_3 string, numeric string, name string, common_name string, official_name string, flag string")
    seeded = etl.seed_countries(iso, {"VN": "Viet Nam"}, {}, {"VN": ["Vietnam"]})
    rows = {r["alpha2"]: r for r in seeded.collect()}
    assert rows["VN"]["name"] == "Viet Nam" and rows["VN"]["alt_names"] == ["Vietnam"] and rows["AD"]["numeric"] == 20 and rows["VN"]["official_name"] == ""
    wiki = spark.createDataFrame([("VIETNAM", "VN", "VNM", "VNM|704|Nam|South Nam|ISO 3166-1:VN|viet nam"), ("Kosovo", "XK", "XKX", "Kosova"), ("No code", "ZZ", "", "Zed land")], "name string, alpha2 string, alpha3 string, aliases string")
    merged = {r["alpha2"]: r for r in etl.merge_aliases(seeded, wiki).collect()}
    assert merged["VN"]["alt_names"] == ["Vietnam", "South Nam"] and set(merged) == {"AD", "VN", "XK"} and merged["XK"]["alt_names"] == ["Kosovo", "Kosova"]
    geo = spark.createDataFrame([("AD", "AN2", "Andorre"), ("VN", "VNM", "vietnam"), ("QQ", "QQQ", "Q")], "alpha2 string, alpha3 string, name string")
    coded = {r["alpha2"]: r for r in etl.merge_codes(seeded, geo).collect()}
    assert coded["AD"]["alpha3"] == "AN2" and coded["AD"]["alt_names"] == ["Andorre"] and coded["VN"]["alt_names"] == ["Vietnam"] and set(coded) == {"AD", "VN"}
    dumped = etl.dumped_countries(spark.createDataFrame([("A", "B", "AA", "AAA", 1, ["z", "A", "b", "z"], "f")], COUNTRY))
    assert dumped.first()["alt_names"] == "b|z"


@pytest.fixture(scope="module")
def countries(spark):
    return spark.createDataFrame([("United States", "", "US", "USA", 840, [], "")], COUNTRY)


def test_subdivision_steps(spark, countries):
    lines = spark.createDataFrame([("US.CA", "California", "California"), ("US.07", "Córdoba West", "Cordoba West"), ("US.08", "Córdoba East", "Cordoba East"), ("US.CA.059", "Orange County", "Orange County"), ("XX.1", "Nowhere", "Nowhere"), ("US.1.2.3", "deep", "deep")], "code string, name string, ascii string")
    geo = etl.geonames_subdivisions(lines, countries).cache()
    by = {r["geonames_code"]: r for r in geo.collect()}
    assert set(by) == {"US.CA", "US.07", "US.08", "US.CA.059"} and by["US.CA.059"]["parent_code"] == "US.CA" and by["US.07"]["alt_names"] == ["Cordoba West"]
    rows = [("US", "US-CA", "State of California", "", "State", "", 1), ("US", "US-CA", "Californie", "", "State", "", 2), ("US", "US-CW", "Western Cordoba", "", "Province", "", 3), ("US", "US-CE", "Cordoba East", "Córdoba-East", "Province", "", 4), ("US", "US-Q", "Quux", "", "Province", "US-CA", 5)]
    iso = etl.iso_subdivisions(spark.createDataFrame(rows, "country_code string, iso_code string, name string, localVariant string, category string, parent_iso_code string, seq int"), countries).cache()
    named = {r["iso_code"]: r for r in iso.collect()}
    assert named["US-CA"]["alt_names"] == ["Californie", "State Of California"] and named["US-CE"]["name"] == "Córdoba-East" and "Cordoba East" in named["US-CE"]["alt_names"] and named["US-Q"]["admin_level"] == 2
    matches = etl.resolved(iso, geo)
    got = {r["iso_code"]: r["id"] for r in matches.collect()}
    assert got == {"US-CA": str(by["US.CA"]["id"]), "US-CE": str(by["US.08"]["id"]), "US-CW": None, "US-Q": None}
    plain = {r["iso_code"]: str(r["id"]) for r in etl.first_match(iso, geo).collect()}
    assert plain == {k: v for k, v in got.items() if v}
    overlay = spark.createDataFrame([("US-Q", None, ["Kwux"], True), ("US-CW", str(by["US.07"]["id"]), ["West C"], False)], "iso_code string, id string, names array<string>, added boolean")
    added, manual = etl.with_overlay(iso, overlay)
    assert [r["iso_code"] for r in added.collect()] == ["US-Q"] and "Kwux" in added.first()["alt_names"]
    whole = etl.merged(iso, geo, matches.where("id IS NOT NULL").unionByName(manual)).unionByName(added.select(*geo.columns))
    final = {r["name"]: r for r in etl.final_subdivisions(whole).collect()}
    assert sorted(r["id"] for r in final.values()) == [1, 2, 3, 4, 5]
    ca = final["State of California"]
    assert ca["iso_code"] == "US-CA" and ca["type"] == "State" and "California" in ca["alt_names"] and ca["country"] == "United States|US|USA"
    assert final["Orange County"]["parent_id"] == ca["id"] and final["Quux"]["parent_id"] == ca["id"] and final["Western Cordoba"]["geonames_code"] == "US.07"


def test_unknown_iso_country_is_an_error(spark, countries):
    rows = spark.createDataFrame([("ZZ", "ZZ-1", "n", "", "c", "", 1)], "country_code string, iso_code string, name string, localVariant string, category string, parent_iso_code string, seq int")
    with pytest.raises(Exception, match="no country ZZ"):
        etl.iso_subdivisions(rows, countries).collect()


def test_city_steps(spark):
    values = {c: "" for c in readers.GEONAMES_COLUMNS}
    make = lambda **kw: tuple((values | {k.replace("_", " "): v for k, v in kw.items()}).values())
    rows = [
        make(geonameid="1", name="São Paulo", asciiname="Sao Paulo", alternatenames="SAO PAULO,Сан,Sampa,sampa,LA, Paulópolis ,X-1", feature_code="PPLA", country_code="BR", admin1_code="27", admin2_code="3", population="100", latitude="1.5", longitude="2"),
        make(geonameid="2", name="Ghost", asciiname="Ghost", feature_code="PPLX", population="5"),
        make(geonameid="3", name="Empty", asciiname="Empty", feature_code="PPL", population="0"),
        make(geonameid="4", name="Lone", asciiname="Lone", feature_code="PPL", country_code="ZZ", population="7", latitude="0", longitude="0"),
    ]
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in readers.GEONAMES_COLUMNS))
    key = lambda *pairs: spark.createDataFrame(list(pairs), "key string, value string")
    got = {r["geonames_id"]: r for r in etl.cities(raw, key(("BR", "Brazil|BR|BRA")), key(("BR.27", "SP|BR.27|BR-SP"), ("BR.27.3", "X|BR.27.3|"))).collect()}
    assert set(got) == {"1", "4"}
    assert got["1"]["alt_names"] == "Sampa|Paulópolis" and got["1"]["admin2"] == "X|BR.27.3|" and got["1"]["population"] == 100
    assert got["4"]["country"] is None and got["4"]["admin1"] is None


def test_load_and_unload(spark, tmp_path):
    path = tmp_path / "cities.tsv"
    path.write_text("\t".join(readers.CITY_COLUMNS) + "\n5\tTown\t\t\t\tX|XX|XXX\t00000042\t1\t2\n")
    cities = Cities()
    cities.load(spark, str(path))
    assert cities.count == 1 and cities[0]["population"] == 42
    cities.unregister()
    with pytest.raises(RuntimeError):
        len(cities)


def test_tables(spark):
    tables.drop(spark, "gz_t")
    tables.create_many(spark, {"gz_t": "a string, b int"})
    tables.insert(spark.createDataFrame([("x", 1)], "a string, b int"), "gz_t")
    assert spark.table("gz_t").count() == 1
    with pytest.raises(ValueError):
        tables.insert(spark.createDataFrame([("x", 1)], "a string, c int"), "gz_t")
    tables.drop(spark, "gz_t")


def test_json_object(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", [1, 2])], "id int, name string, n array<int>")
    tables.write_json_object(df, str(tmp_path / "o"), "id")
    (part,) = (tmp_path / "o").glob("part-*")
    text = part.read_text()
    assert json.loads(text) == {"1": {"name": "a", "n": [1, 2]}, "2": {"name": "b", "n": None}} and "\n" in text.strip()
    with pytest.raises(Exception):
        tables.write_json_object(df.unionByName(df), str(tmp_path / "p"), "id")


def brute_resolution(iso, geo):
    """(iso code, id) in order, names growing as rows merge; by difflib-free plain Python."""
    geo = [(key, list(names)) for key, names in geo]
    out = {}
    for code, names in iso:
        out[code] = None
        for key, own in geo:
            if any(etl._same(a, b) for a in names for b in own):
                out[code] = str(key)
                own += [n for n in names if n not in own]
                break
    return out


def test_entity_resolution_walks_in_file_order(spark):
    import random

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "north", "river", "lake"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(["", "s", "x"])
    # ids as numbers, as text and by line give three different orders
    ids = rng.sample([*range(1, 12), *range(95, 120), *range(1000, 1010)], 40)
    geo = [(decimal.Decimal(i), name(), ["g" + name()], k) for k, i in enumerate(ids)]
    iso = [(f"X-{k:02}", name(), [name()]) for k in range(40)]
    shape = "alpha2 string, admin_level int, iso_code string, alt_names array<string>"
    g = spark.createDataFrame([(i, n, k, "XX", 1, "", a) for i, n, a, k in geo], "id decimal(20,0), name string, seq int, " + shape)
    i = spark.createDataFrame([(decimal.Decimal(0), n, "XX", 1, c, a) for c, n, a in iso], "id decimal(20,0), name string, " + shape)
    got = {r["iso_code"]: r["id"] for r in etl.resolved(i, g, order="seq").collect()}
    want = brute_resolution([(c, [n, *a]) for c, n, a in iso], [(i, [n, *a]) for i, n, a, _ in geo])
    assert got == want and sum(v is not None for v in want.values()) > 10
    first = {r["iso_code"]: str(r["id"]) for r in etl.first_match(i, g, "seq").collect()}
    assert first[iso[0][0]] == want[iso[0][0]] if want[iso[0][0]] else iso[0][0] not in first


def test_relocate(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    tables.relocate(spark, str(tmp_path / "a"), str(tmp_path / "deep" / "b"))
    assert spark.read.parquet(str(tmp_path / "deep" / "b")).count() == 3 and not tables.exists(spark, str(tmp_path / "a"))
    spark.range(1).write.parquet(str(tmp_path / "c"))
    with pytest.raises(FileExistsError):
        tables.relocate(spark, str(tmp_path / "c"), str(tmp_path / "deep" / "b"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1


def test_batch_get_gives_the_first_of_several(spark):
    from gazelark.operators import lookup

    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id int, k string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "want string")
    assert sorted((r["want"], r["id"]) for r in lookup.batch_get(keys, df, "want", "k").collect()) == [("a", 1), ("a", 1), ("b", 2)]


def test_command_line_loads_counts_searches_and_unloads(spark, tmp_path, capsys):
    from gazelark import cli

    path, store = tmp_path / "c.tsv", str(tmp_path / "store")
    rows = [("Germany", "DE", "DEU"), ("Georgia", "GE", "GEO"), ("Ghana", "GH", "GHA")]
    path.write_text("\t".join(readers.COUNTRY_COLUMNS) + "\n" + "".join(f"{n}\t\t{a}\t{b}\t{i}\t\tf\n" for i, (n, a, b) in enumerate(rows)))
    assert cli.main(["count", "countries", store], spark) == 1
    for _ in range(2):  # loading again replaces
        assert cli.main(["load", "countries", str(path), store], spark) == 0
    capsys.readouterr()
    assert cli.main(["count", "countries", store], spark) == 0 and capsys.readouterr().out == "3\n"
    assert cli.main(["search", "countries", store, "Germny"], spark) == 0
    assert capsys.readouterr().out.startswith("1\tGermany\t0.9")
    assert cli.main(["unload", "countries", store], spark) == 0 and cli.main(["count", "countries", store], spark) == 1
