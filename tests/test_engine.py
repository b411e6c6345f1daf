"""Gets, predicates, full text, fuzzy search and hierarchies on small tables, and against SQLite's full-text index."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from gazelark.operators import fts, fuzzy, hierarchy, lookup
from gazelark.plans.registries import Cities, Countries, Subdivisions
from gazelark.spec import COUNTRIES, EntitySpec

COUNTRY_ROWS = [
    (1, "Andorra", "Principality of Andorra", "AD", "AND", "20", "", "f1"),
    (2, "United States", "United States of America", "US", "USA", "840", "America|Amerique", "f2"),
    (3, "Côte d'Ivoire", "Republic of Côte d'Ivoire", "CI", "CIV", "384", "Ivory Coast|Cote d'Ivoire", "f3"),
    (4, "Australia", None, "AU", "AUS", "36", None, "f4"),
    (5, "Austria", "Republic of Austria", "AT", "AUT", "40", "Österreich", "f5"),
    (6, "Nowhere", None, "NW", "NWH", None, "one two|three four", "f6"),
]
COUNTRY_SCHEMA = "id bigint, name string, official_name string, alpha2 string, alpha3 string, numeric string, alt_names string, flag string"
US, AU = "United States|US|USA", "Australia|AU|AUS"


@pytest.fixture(scope="module")
def countries(spark):
    return Countries(spark.createDataFrame(COUNTRY_ROWS, COUNTRY_SCHEMA))


@pytest.fixture(scope="module")
def subdivisions(spark, countries):
    rows = [
        (1, "California", "Cali|Golden State", "US.CA", "US-CA", US, "State", None),
        (2, "Guam", None, "US.GU", "US-GU", US, "Outlying area", None),
        (3, "Orange County", None, "US.CA.059", "", US, "County", "1"),
        (4, "Victoria", None, "AU.07", "AU-VIC", AU, "State", None),
    ]
    return Subdivisions(spark.createDataFrame(rows, "id bigint, name string, alt_names string, geonames_code string, iso_code string, country string, type string, parent_id string"), countries)


@pytest.fixture(scope="module")
def cities(spark, countries, subdivisions):
    ca, oc = "California|US.CA|US-CA", "Orange County|US.CA.059|"
    rows = [
        (1, "Los Angeles", "5368361", ca, "LA County|US.CA.037|", US, "LA|City of Angels", 3_900_000, 34.0, -118.2),
        (2, "Irvine", "5359777", ca, oc, US, None, 250_000, 33.7, -117.8),
        (3, "Tinytown", "9", None, oc, US, None, 50, 33.0, -117.0),
        (4, "Melbourne", "2158177", "Victoria|AU.07|AU-VIC", None, AU, "Melburn", 4_500_000, -37.8, 144.9),
        (5, "Null Island", "0", None, None, None, None, 0, 0.0, 0.0),
    ]
    return Cities(spark.createDataFrame(rows, "id bigint, name string, geonames_id string, admin1 string, admin2 string, country string, alt_names string, population bigint, lat double, lng double"), countries, subdivisions)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_get(countries, subdivisions, cities):
    assert ids(countries.get(alpha2="US")) == ids(countries.get(alpha3="USA")) == ids(countries.get(numeric=840)) == ids(countries.get(id="2")) == [2]
    assert ids(countries.get(id=1, numeric=-5)) == ids(countries.get(id=-1)) == ids(countries.get(pid=1)) == ids(countries.get()) == ids(countries.get(alpha2="us")) == ids(countries.get(alpha2="")) == ids(countries.get(id="")) == []
    assert ids(subdivisions.get(iso_code="US-CA")) == ids(subdivisions.get(geonames_code="US.CA")) == [1]
    assert ids(cities.get(geonames_id=5359777)) == [2]


def test_predicates(countries):
    df = countries.table
    where = lambda c: sorted(ids(df.where(c)))
    assert where(lookup.equals(COUNTRIES, "flag", "f1")) == [] and where(lookup.equals(COUNTRIES, "name", "Andorra") | lookup.equals(COUNTRIES, "alpha2", "AU")) == [1, 4]
    assert where(lookup.differs("official_name", "x")) == [1, 2, 3, 5]
    assert where(lookup.compared("numeric", "<", 3)) == [1] and where(lookup.compared("numeric", ">=", 384)) == [2, 3, 5]
    assert where(lookup.is_in("numeric", [20, 36])) == [1, 4] and where(lookup.is_like("name", "%STRI_")) == [5]


def test_scan_slice_iterate_and_records(countries, subdivisions, cities):
    assert len(countries) == countries.count == 6 and [r["id"] for r in countries] == [1, 2, 3, 4, 5, 6]
    assert countries[0]["name"] == "Andorra" and countries[-1]["numeric"] is None and countries[1]["alt_names"] == ["America", "Amerique"]
    for s in (slice(1, 3), slice(-2, None), slice(None, None, -2), slice(5, 1), slice(0, 6, 4)):
        assert [r["id"] for r in countries[s]] == [1, 2, 3, 4, 5, 6][s]
    with pytest.raises(IndexError):
        countries[9]
    sub = subdivisions[2]
    assert (sub["admin_level"], sub["parent_id"], sub["country"]["alpha2"]) == (2, 1, "US") and subdivisions[0]["admin_level"] == 1
    la, tiny, null = cities[0], cities[2], cities[4]
    assert la["display_name"] == "Los Angeles, LA County, California, United States" and [x["admin_level"] for x in la["subdivisions"]] == [1, 2] and la["subdivisions"][1]["iso_code"] is None
    assert tiny["display_name"] == "Tinytown, Orange County, United States" and null["display_name"] == "Null Island, " and null["subdivisions"] == [] and null["country"] is None
    assert '"name":"Andorra"' in lookup.as_records(countries.records().where("id = 1")).first()["record"]


def test_filter_contracts(countries, subdivisions):
    assert ids(countries.filter(name="AUSTRIA")) == [5] and ids(countries.filter(alt_name="ivory")) == [3] and ids(countries.filter(official_name="republic", limit=1)) in ([3], [5])
    assert ids(countries.filter("asjh238gjs")) == ids(countries.filter("")) == ids(countries.filter(colour="x")) == ids(countries.filter("!@#$%")) == []
    assert ids(countries.filter("Bolivia", name="Andorra")) == [1]
    assert sorted(ids(countries.filter("republic cote"))) == [3] and ids(countries.filter("d'ivoire")) == [3] and ids(countries.filter("two|three")) == [6]
    assert sorted(ids(subdivisions.filter(type="state", country="US"))) == [1]
    for bad in (dict(query=" "), dict(name='a"b'), dict(query="x", limit=0), dict(query="x", offset=2), dict(query="x", limit=2, offset=0)):
        with pytest.raises(ValueError):
            countries.filter(**bad)
    with pytest.raises(ValueError):
        subdivisions.filter(type="")


def test_hierarchy(countries, subdivisions, cities):
    assert ids(subdivisions.for_country(alpha2="US")) == [1, 2] and ids(subdivisions.for_country(alpha2="US", admin_level=2)) == [3] and sorted(ids(subdivisions.for_country(numeric=840, admin_level=None))) == [1, 2, 3]
    assert ids(subdivisions.for_country(alpha2="abcbbd")) == []
    assert [r["type"] for r in subdivisions.types_for_country(alpha2="US").collect()] == ["Outlying area", "State"] and subdivisions.types_for_country(alpha2="US", admin_level=None).count() == 0
    assert sorted(ids(cities.for_country(alpha3="USA"))) == [1, 2, 3] and ids(cities.for_country(alpha2="US", population__gt=250_000)) == [1] and ids(cities.for_country(alpha2="US", population__lt=100)) == [3]
    with pytest.raises(ValueError):
        cities.for_country(alpha2="US", population__lt=1, population__gt=2)
    assert sorted(ids(cities.for_subdivision(iso_code="US-CA"))) == [1, 2] and ids(cities.for_subdivision(iso_code="US-CA", population__gt=500_000)) == [1]
    assert sorted(ids(cities.for_subdivision(geonames_code="US.CA.059"))) == [2, 3] and ids(cities.for_subdivision(geonames_code="US.CA.059", population__lt=100)) == [3]
    assert ids(cities.for_subdivision(iso_code="US-CA", population__gt=0)) and ids(cities.for_subdivision(id=9999999999)) == ids(cities.for_subdivision(iso_code="")) == []
    assert {r["id"]: r["parent_name"] for r in hierarchy.with_parents(subdivisions.table).collect()} == {1: None, 2: None, 3: "California", 4: None}


def test_not_loaded():
    with pytest.raises(RuntimeError):
        Cities().count


@pytest.mark.parametrize("query,best", [("Austrlia", "Australia"), ("andora", "Andorra"), ("Amerca", "United States"), ("ivry coast", "Côte d'Ivoire"), ("andorra", "Andorra")])
def test_search_finds_typos(countries, query, best):
    rows = countries.search(query, limit=3).collect()
    assert rows and rows[0]["name"] == best and rows[0]["score"] >= 0.6


def test_search_edges(spark, countries):
    assert countries.search("").count() == countries.search("zzzzzzzzz").count() == countries.search("!@#$%").count() == 0
    with pytest.raises(ValueError):
        countries.search("  ")
    batch = spark.createDataFrame([(1, "andorra"), (2, None), (3, "")], "qid int, query string")
    assert [r["qid"] for r in countries.search(batch).collect()] == [1]


def test_bm25_as_in_a_full_text_index(spark):
    rng = random.Random(4)
    vocab = ["red", "blue", "über", "ring", "rod", "rods", "gear's", "a-b", "x"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 6))), "|".join(rng.choices(vocab, k=rng.randint(0, 9)))) for i in range(1, 120)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(name, alt, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, name, alt) VALUES (?, ?, ?)", rows)
    spec = EntitySpec("t", ("name", "alt"))
    index = fts.TextIndex.build(spark.createDataFrame(rows, "id bigint, name string, alt string"), spec).cached()
    for query, fields, exact in [("red", None, True), ("uber ring", None, True), ("gear's", None, True), ("ro", None, False), ("a-b r", None, False), (None, {"name": "red"}, True), (None, {"alt": "rod"}, True)]:
        match = " ".join(f'"{w}"' + ("" if exact else "*") for w in (query or next(iter(fields.values()))).split())
        column = next(iter(fields)) if fields else "t"
        want = {r[0]: r[1] for r in db.execute(f"SELECT rowid, bm25(t, 50.0) FROM t WHERE {column} MATCH ?", (match,))}
        got = {r["id"]: r["rank"] for r in fts.fts_match(index, query, fields, exact).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want), (query, fields)


def test_stop_rounds_follow_the_loop(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for q in range(60):
        rounds = rng.randint(1, 9)
        per_round = {r: [rng.choice([0.3, 0.65, 0.7, 0.9] if rng.random() < 0.15 else [0.3, 0.65]) for _ in range(rng.randint(0, 3))] for r in range(1, rounds + 1)}
        rows += [(q, rounds, r, s) for r, x in per_round.items() for s in x]
        counts, total, strong, stop = [0], 0, False, None
        for r in range(1, rounds + 1):
            total += sum(s >= 0.6 for s in per_round[r])
            strong |= any(s >= 0.85 for s in per_round[r])
            if r == rounds or strong:
                stop = r
                break
            counts.append(total - counts[-1])
            if counts[-2] and r >= 3 and counts[-1] + counts[-2] <= 1:
                stop = r
                break
        if any(per_round.values()):
            want[q] = stop
    got = {r["qid"]: r["stop"] for r in fuzzy.stop_rounds(spark.createDataFrame(rows, "qid int, rounds int, round int, score double")).collect()}
    assert got == want


def test_rounds_follow_truncation(spark):
    """Against truncating and matching prefixes round by round in SQLite."""
    rng = random.Random(2)
    names = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) + rng.choice(["", " ", "-", "'"]) + "".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(name, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, name) VALUES (?, ?)", list(enumerate(names, 1)))
    spec = EntitySpec("t", ("name",))
    df = spark.createDataFrame(list(enumerate(names, 1)), "id bigint, name string")
    asked = ["ab", "abé ba", "aab-ba", "bé'a ab", "aaaab"]
    want = {}
    for q, query in enumerate(asked):
        words = query.lower().split()
        for r in range(1, max(map(len, words)) + 1):
            match = " ".join(f'"{w[: max(1, len(w) - r + 1)]}"' + ("*" if r > 1 else "") for w in words)
            for (i,) in db.execute("SELECT rowid FROM t WHERE t MATCH ?", (match,)):
                want.setdefault((q, i), r)
    got = fuzzy.rounds_of_rows(spark.createDataFrame(list(enumerate(asked)), "qid int, query string"), df, fts.TextIndex.build(df, spec))
    assert {(r["qid"], r["id"]): r["round"] for r in got.collect()} == want


def test_search_scores_a_text_once_for_all_its_rows(spark, monkeypatch):
    """Rows of equal texts are ranked by price, round and id, and what is scored doesn't grow with them."""
    names = [("red widget", "x"), ("red gadget", None), ("rod widget", "x"), ("blue bolt", "y"), (None, "x")]
    spec = EntitySpec("copies", ("name", "kind"), weights={"name": 1.0}, order_fields=("price",))
    rows = [(i, *names[i % 5], float(i * 7 % 11)) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, name string, kind string, price double")
    asked = spark.createDataFrame([(0, "red widget"), (1, "rod widgets")], "qid int, query string")
    scored, stops = [], fuzzy.stop_rounds
    monkeypatch.setattr(fuzzy, "stop_rounds", lambda s: (scored.append(s.count()), stops(s))[1])
    index = fts.TextIndex.build(df, spec)
    every = fuzzy.search(asked, df, index).collect()
    for q in (0, 1):
        mine = sorted((r for r in every if r["qid"] == q), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))
        assert mine == sorted(mine, key=lambda r: (-r["score"], -r["price"], r["round"], r["id"])) and all(r["id"] % 5 == [n for n, _ in names].index(r["name"]) for r in mine)
        assert len(mine) == 80 * len({r["name"] for r in mine})
    for limit in (7, 100):
        few = fuzzy.search(asked, df, index, limit).collect()
        assert sorted(few, key=lambda r: (r["qid"], r["place"])) == sorted((r for r in every if r["place"] <= limit), key=lambda r: (r["qid"], r["place"]))
    assert max(scored) <= 2 * len(names)


def test_ties_of_misspelt_searches_are_cut_by_rows_not_texts(spark):
    """A limit counts the rows of better texts, so worse texts come in only where it leaves room."""
    kept = spark.createDataFrame([(0, 0.9, 4), (0, 0.9, 5), (0, 0.8, 1), (0, 0.7, 1), (1, 0.7, 1), (1, 0.6, 9)], "qid int, score double, n bigint")
    best = lambda limit: sorted((r["qid"], r["score"], r["n"]) for r in fuzzy._best(kept, limit).collect())
    assert best(10) == [(0, 0.8, 1), (0, 0.9, 4), (0, 0.9, 5), (1, 0.6, 9), (1, 0.7, 1)]
    assert best(9) == [(0, 0.9, 4), (0, 0.9, 5), (1, 0.6, 9), (1, 0.7, 1)] and best(1) == [(0, 0.9, 4), (0, 0.9, 5), (1, 0.7, 1)]


def test_ids_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    rows = sorted((r["id"], r["k"]) for r in lookup.with_ids(df, "k").collect())
    assert [r[0] for r in rows] == list(range(1, 1001)) and [r[1] for r in rows] == sorted(r[1] for r in rows)
