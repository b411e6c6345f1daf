import random

import numpy as np

import colliding  # beside this file
from gazelark.llm import _shared


def test_components_of_chains_stars_and_random_edges(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000 + i, 1000) for i in range(1, 200)]
    loose = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    edges = chain + star + loose + [(5, 5), (7, 8), (8, 7)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in edges:
        if x != y:
            x, y = root(x), root(y)
            label[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in _shared.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {x: root(x) for x in label}
    assert _shared.components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []


def test_words_are_told_apart_by_their_bytes_even_if_all_hashes_meet(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abÉ") for _ in range(rng.choice([1, 7, 8, 9, 16, 63, 64, 65, 200]))) for _ in range(500)] + list(colliding.pair(91))
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    begin, end, _ = _shared.words(raw, np.array([0, len(raw)]))
    for hashes in (None, lambda *_: np.zeros(len(words), np.uint64)):
        if hashes:
            monkeypatch.setattr(_shared, "word_hashes", hashes)
        _, one, back = _shared.word_kinds(raw, begin, end)
        assert len(one) == len(set(words))
        named = _shared.word_bytes(raw, begin[one], end[one]).to_pylist()
        assert [named[k].decode() for k in back] == words


def test_table_finds_what_it_holds():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.uint64))
    asked = np.concatenate([keys, keys + np.uint64(1)])
    want = np.where(np.isin(asked, keys), np.searchsorted(keys, asked), -1)
    assert (_shared.Table(keys).find(asked) == want).all()
    assert (_shared.Table(keys[:0]).find(asked) == -1).all()


def test_written_tables_go_and_a_cluster_needs_a_shared_folder(spark):
    df = _shared.written(spark.range(5))
    path = df._gazelark_path
    assert df.count() == 5 and path.startswith(_shared.shared_folder(spark))
    _shared.dropped(df)
    assert not list(__import__("pathlib").Path(path.removeprefix("file:")).glob("*"))


def test_batches_are_small_unless_the_session_says_smaller(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        for given, want in (("64m", str(_shared.BATCH_BYTES)), ("1m", "1m")):
            spark.conf.set(name, given)
            _shared.small_batches(spark)
            assert spark.conf.get(name) == want
        spark.conf.set(name, "64k")
        sizes = spark.range(40, numPartitions=1).selectExpr("repeat('x', 10000) AS t").mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "t string").count()
        assert sizes >= 5  # as many batches
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
