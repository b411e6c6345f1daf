"""The two operators without Python on executors, against their SQL and against plain Python, and the pipeline's stages."""

import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gazelark.llm import jaccard, mixing, packing, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def made(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["the", "a|b", "###", "é"]
    rows = [(0, None, None, None, None, "x"), (1, "", "en", "a", 0, "x"), (2, " \n\t ", "en", None, 3, "x"), (3, "one two three four five six", "en", "a", 9, "x")]
    for i in range(4, n):
        line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12)))
        lines = [line() for _ in range(rng.randint(1, 6))]
        text = "\n".join(lines + [rng.choice(lines) for _ in range(rng.randint(0, 6))])
        rows.append((i, text, "en", rng.choice(["hot", "hot", "hot", "a", "b", "Z", "é", None]), len(text), "x"))
    return rows


def frames(spark, rows):
    return spark.createDataFrame(rows, SCHEMA), pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars", "size"])


def same(df, sql, documents):
    con = duckdb.connect()
    con.register("raw", documents)
    con.sql("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM raw")
    want = con.sql(sql)
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    tidy = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    got = sorted((tidy(r[c] for c in names) for r in df.collect()), key=repr)
    listed = ", ".join(f'"{n}"' for n in names)
    assert got == sorted((tidy(r) for r in con.sql(f"SELECT {listed} FROM ({sql})").fetchall()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_as_in_sql(spark, seed):
    docs, table = frames(spark, made(seed))
    same(quality.quality(docs), quality.OP2_SQL.replace("{docs}", "documents"), table)


def test_quality_measures_as_in_python(spark):
    rows = made(3)
    docs, _ = frames(spark, rows)
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for key, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        r = got[key]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, key
        assert r["base_failed"] == (len(words) < 10 or 100 * len(inside) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_a_rejected_host_loses_documents_that_break_a_rule(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "x", "bad") for i in range(30)] + [(100, good + " ### ### ### ###", "bad"), (101, good, "bad"), (102, good + " ### ### ### ###", "ok")] + [(200 + i, good + f" {i}", "ok") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(docs).collect()}
    assert (kept[100], kept[101], kept[102], kept[0], kept[200]) == (False, True, True, False, True)
    assert {r["doc_id"] for r in quality.keep(docs).collect()} == {k for k, v in kept.items() if v}
    assert quality.quality(docs.limit(0)).collect() == [] and quality.keep(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_as_in_sql(spark, seed):
    docs, table = frames(spark, made(seed))
    mixed = mixing.mix(docs).select("doc_id", F.col("size"), "source_size", "target", "taken")
    same(mixed, mixing.OP6_SQL, table)


def test_mix_meets_its_targets_and_budget(spark):
    docs, _ = frames(spark, made(5, 400))
    rows = mixing.mix(docs).collect()
    assert sum(r["taken"] for r in rows) <= sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"] if r["size"] else r["taken"] == 0
        by.setdefault(r["source"], [r["target"], 0, 0])
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = max(by[r["source"]][2], r["size"])
    assert all(abs(got - target) <= 2 * largest for target, got, largest in by.values())
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.take(docs.limit(0)).collect() == []


def test_take_repeats_rows_as_often_as_the_mix_says(spark):
    rows = made(6, 60)
    rows += [rows[10]] * 3
    docs, _ = frames(spark, rows)
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in taken.collect())
    keyed = docs.withColumn("row", mixing.identity(docs))
    assert total == mixing.mix(keyed, key="row").agg(F.sum("taken")).first()[0]


def test_take_loses_no_row_that_differs_in_another_column(spark):
    rows = [(1, "a b c", "s", n) for n in ("x", "y", None)] * 2 + [(None, "d e", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string")
    took = Counter(tuple(r) for r in mixing.take(docs, budget=1000).collect())
    assert took == {row: 3 * n for row, n in Counter(rows).items()}
    odd = docs.withColumns({"a.b": F.create_map(F.lit("k"), F.col("row")), "copy": F.lit(1)})
    assert mixing.take(odd, budget=1000).columns == odd.columns and mixing.take(odd, budget=1000).count() == 21


def test_mix_of_equal_keys_and_null_keys_as_in_sql(spark, monkeypatch):
    rows = [(i % 7 if i % 5 else None, " ".join(["w"] * (i % 13)), "en", "ab"[i % 2], 1, "x") for i in range(90)]
    docs, table = frames(spark, rows)
    table["doc_id"] = table["doc_id"].astype("Int64")
    for edge in (10_000, 2):
        monkeypatch.setattr(mixing, "EDGE", edge)
        same(mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken"), mixing.OP6_SQL, table)


def test_mix_ranges_again_until_few_copies_are_left(spark, monkeypatch):
    docs, _ = frames(spark, made(11, 300))
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "EDGE", 1)
    assert sorted(map(str, mixing.mix(docs).collect())) == want


def test_pipeline_stages_do_what_the_operators_say(spark, tmp_path):
    rows = [r[:5] for r in made(8, 120)]
    good = " ".join(f"term{i}" for i in range(40))
    rows += [(500, good + " mail a.b@example.com", "en", "a", 1), (501, good + " mail a.c@example.com", "en", "b", 1), (502, good.replace("term", "other") + " call +1 (555) 555-0100", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    kept = corpus_pipeline.quality_stage(spark, docs, d)
    want = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns and {500, 501, 502} <= want
    unique = corpus_pipeline.near_duplicate_stage(spark, kept, d)
    firsts = {r["component_id"] for r in jaccard.jaccard_components(kept, k=5, percent=80).collect()}
    assert {r["doc_id"] for r in unique.collect()} == firsts and 501 not in firsts and unique.columns == docs.columns
    clean = {r["doc_id"]: r for r in corpus_pipeline.pii_stage(spark, unique, d).collect()}
    assert set(clean) == firsts and clean[500]["text"] == good + " mail [email]" and clean[500]["n_chars"] == len(clean[500]["text"]) and clean[502]["text"].endswith("call [phone]")
    assert all(clean[r["doc_id"]]["text"] == pii.redacted(r["text"]) for r in unique.collect())
    packed = corpus_pipeline.run(spark, d).collect()
    sizes = Counter()
    for r in packed:
        sizes[r["sequence_id"]] += r["length"]
    assert all(n == packing.WINDOW or n & (n - 1) == 0 for n in sizes.values()) and {r["doc_id"] for r in packed} <= firsts


def test_quality_of_repeated_keys_null_keys_and_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (7, long, None), (7, "x " * 60, "s"), (7, None, "s")]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got == [(0, 3, 0, True), (0, 3, 0, True), (7, 0, 0, True), (7, 60, 60, True), (7, 200_000, 0, False)]


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, word string, part string, host string, _row string, size string"


def odd(n=30):
    good = lambda k: " ".join(f"t{k}w{i}" for i in range(30))
    rest = ("r", None, "p", "h", "_", "s")
    rows = [(None, good(0), "en", "a", 1, *rest), (None, good(0), "en", "a", 1, *rest), (5, good(1), "en", "a", 1, *rest), (5, good(1), "en", "a", 1, *rest), (5, good(2), "en", None, 1, *rest), (6, good(2), "en", "b", 1, *rest), (7, None, None, None, None, *rest), (8, "", "en", "a", 0, *rest)]
    return rows + [(10 + i, good(10 + i), "en", "ab"[i % 2], 1, *rest) for i in range(n)]


def test_pipeline_stages_on_odd_rows_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame(odd(), CLASHING)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        none = stage(spark, docs.limit(0), "")
        assert none.collect() == [] and none.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").collect() == []
    kept = corpus_pipeline.quality_stage(spark, docs, "")
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([None, None, 5, 5, 5, 6, *range(10, 40)])
    unique = Counter((r["doc_id"], r["text"][:3]) for r in corpus_pipeline.near_duplicate_stage(spark, kept, "").collect())
    # rows without an id stay; of one document the two texts stay, each once; 6 is a copy of a part of 5
    assert unique == Counter([(None, "t0w"), (None, "t0w"), (5, "t1w"), (5, "t2w"), *[(i, f"t{i}") for i in range(10, 40)]])
    taken = corpus_pipeline.mixing_stage(spark, kept, "")
    assert {r["text"] for r in taken.collect()} <= {r["text"] for r in kept.collect()}
    packed = corpus_pipeline.packing_stage(spark, kept, "").collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in kept.collect())
