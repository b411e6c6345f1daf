"""Scalar functions against SQLite's tokenizer, Python and literal cases."""

import hashlib
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from gazelark.functions import text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def sqlite_tokens(value):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a, tokenize='unicode61 remove_diacritics 2')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    db.execute("INSERT INTO t VALUES (?)", (value,))
    return [r[0] for r in db.execute('SELECT term FROM v ORDER BY "offset"')]


@pytest.mark.parametrize("value", ["Côte d'Ivoire", "ŁÓDŹ", "İstanbul", "Straße 12", "US-CA", "NATION_0", "Ḁ̂ ế Ǖ ÿ", "a|b c", "Ångström ø æ", "  ", "Москва Ёлка", "東京 tower", "x́y"])
def test_tokens_as_the_tokenizer_of_a_full_text_index(spark, value):
    want = sqlite_tokens(value)
    assert text.py_tokens(value) == want
    assert one(spark, text.tokens("a"), a=value) == want


def test_latin_letters_fold_as_in_the_index(spark):
    letters = [chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if unicodedata.category(chr(c))[0] == "L"]
    letters = [c for c in letters if unicodedata.normalize("NFD", c)[0].isascii()]
    assert [text.py_tokens(c) for c in letters] == [sqlite_tokens(c) for c in letters]


def test_clean_pad_split_join(spark):
    assert one(spark, text.clean("a"), a=" \t") is None and one(spark, text.clean("a"), a=" x") == " x"
    assert [one(spark, text.zero_padded("a"), a=n) for n in (5, 123456789, -7)] == ["00000005", "123456789", "-0000007"]
    assert one(spark, text.split_bar("a"), a="") == [] and one(spark, text.split_bar("a"), a="x|y") == ["x", "y"]
    assert one(spark, text.join_bar("a", "b"), a="x", b=None) == "x|"


def test_compounds(spark):
    got = one(spark, text.compound("a", ("name", "alpha2", "alpha3")), a="X||Z")
    assert got.asDict() == {"name": "X", "alpha2": None, "alpha3": "Z"}
    with pytest.raises(Exception, match="3 parts"):
        one(spark, text.compound("a", ("name", "alpha2", "alpha3"), strict=True), a="X|Y")


def test_like_folds_ascii_only(spark):
    assert one(spark, text.like("a", "%AB_d%"), a="xabcD\ny") is True
    assert one(spark, text.like("a", "a.c"), a="abc") is False


@pytest.mark.parametrize("value", ["hello world", "they're bill's", "ÎLE-de-france", "a1b2 c", "", "ßa"])
def test_titled(spark, value):
    got = one(spark, text.titled("a"), a=value)
    assert got == (value.title() if not value.startswith("ß") else "SSa")


def test_deduped_keeps_the_shortest_spelling_sorted(spark):
    assert one(spark, text.deduped("a"), a=["Beta", "beta", "alpha", "ALPHA", "Gamma"]) == ["Beta", "Gamma", "alpha"]


def test_hash_id(spark):
    want = int.from_bytes(hashlib.md5(b"US|1|ca|US-CA").digest()[:8], "big")
    assert int(one(spark, text.hash_id(F.lit("US"), F.lit(1), "a", F.lit("US-CA")), a="ca")) == want


@pytest.mark.parametrize("value,want", [("Sao Tomé-X", True), ("d’Ivoire's", True), ("Москва", False), ("St. John", False), ("B2", False), ("", True), ("ª", False)])
def test_is_latin(spark, value, want):
    assert one(spark, text.is_latin("a"), a=value) is want


def test_names_for_comparison(spark):
    assert one(spark, text.comparable("a"), a="São-Paulo (State), Šumadija") == "sao paulo sumadija"
    assert one(spark, text.decomposed("a"), a="ÉＡﬁ") == "eafi"
    assert one(spark, text.ascii_name("a"), a=" Łódź ə ß ") == "Lodz a ss"


@pytest.mark.parametrize("a,b,want", [("abc", "abcd", 70), ("abcdef", "abcdefgh", 75), ("ab cd ef gh", "ab cd", 80), ("a long name here", "another long name", 90)])
def test_match_threshold(spark, a, b, want):
    assert one(spark, text.match_threshold("a", "b"), a=a, b=b) == want


def test_directions(spark):
    assert one(spark, text.directions_differ("a", "b"), a="North X", b="x south") is True
    assert one(spark, text.directions_differ("a", "b"), a="North X", b="x north") is False


def test_common_subsequence_of_long_texts(spark):
    import random

    from gazelark.functions import similarity

    rng = random.Random(1)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            before = 0
            for j, d in enumerate(b):
                before, row[j + 1] = row[j + 1], max(row[j + 1], row[j], before + (c == d))
        return row[-1]

    made = lambda sizes: "".join(rng.choice("abcé ") for _ in range(rng.choice(sizes)))
    pairs = [(made([0, 1, 5, 61, 62, 63, 130]), made([0, 1, 5, 61, 62, 63, 124, 125, 130])) for _ in range(60)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in rows] == [plain(a, b) for a, b in pairs]


def test_latin_letters_of_very_long_texts(spark):
    rows = [("é" * 300_000, True), ("a b-c'd’e " * 20_000, True), ("a" * 300_000 + "ж", False), ("", True), ("ª", False), ("a1", False)]
    got = spark.createDataFrame(rows, "t string, want boolean").select(text.is_latin("t").alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_typos_change_as_much_as_they_say(spark):
    from gazelark.functions import typos

    rows = [(i, "the quick brown fox jumps"[: 3 + i]) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, t string")
    one = [(r["t"], r["x"]) for r in df.select("t", typos.with_typos(F.col("t"), F.col("i")).alias("x")).collect()]
    assert one == [(r["t"], r["x"]) for r in df.repartition(3).orderBy("i").select("t", typos.with_typos(F.col("t"), F.col("i")).alias("x")).collect()]
    assert all(t[0] == x[0] and abs(len(t) - len(x)) <= max(1, int(len(t) * 0.075)) for t, x in one)
    assert one[0][0] == one[0][1] and sum(t != x for t, x in one[1:]) >= 15
