import random
import re

import colliding  # beside this file
import numpy as np
import pytest

from gazelark.llm import jaccard

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def mutated(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("k,percent,seed", [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_components_equal_brute_force(spark, k, percent, seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    common = [rng.choice(vocab) for _ in range(25)]
    texts = [None, "", " \n", "one", "ONE", "one two", "One Two", "one two three four five", "ONE two three four five "]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(8, 80))]
        texts += [" ".join(mutated(rng, base, rng.randint(0, 4))) for _ in range(rng.randint(1, 8))]
        texts.append(" ".join(base + common))
    hot = [rng.choice(vocab) for _ in range(70)]  # one large group, of which many are near the border
    texts += [" ".join(mutated(rng, hot, rng.randint(0, 6))) for _ in range(120)] + [" ".join(hot).upper()] * 5
    rng.shuffle(texts)
    rows = [(7 * i + 3, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, k=k, percent=percent).collect()}
    want = brute(rows, k, percent)
    assert {i: (got.get(i), want[i]) for i in want if got.get(i) != want[i]} == {}


def test_null_keys_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, None), (4, "a b c d e"), (4, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"] or 0) for r in jaccard.jaccard_components(docs).collect())
    assert got == [(0, 0, 0), (0, 2, 0), (2, 2, 2), (4, 2, 2), (4, 2, 2)]
    assert jaccard.jaccard_components(docs.limit(0)).collect() == []


def test_long_lists_meet_by_lanes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LANE", 3)
    rng = random.Random(6)
    common = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join(common + [f"v{rng.randrange(40)}" for _ in range(rng.randint(1, 6))])) for i in range(120)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=70).collect()}
    assert got == brute(rows, 3, 70)


def test_colliding_words_and_very_long_texts(spark):
    a, b = colliding.pair(91)
    rest = " ".join(f"w{i}" for i in range(9))
    long = " ".join(f"t{i % 99991}" for i in range(400_000))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, long), (4, long + " end")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (7, 1) and got[2] == (7, 2) and got[3][1] == got[4][1] == 3


def test_signatures_tell_long_unlike_sets_apart():
    rng = np.random.default_rng(2)
    for n in (200, 1500, 2000):
        sets = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = jaccard._parity(sets, np.array([0, n]), np.array([True, True])).view(np.uint64).reshape(2, -1)
        differ = int(np.bitwise_count(a ^ b).sum())
        assert differ <= 2 * n  # a bound of what the sets differ in
        assert 180 * (2 * n - differ) < 2 * 80 * 2 * n  # too much for a similarity of 80 %
