import hashlib
import random

import numpy as np
import pytest

import colliding  # beside this file

from gazelark.llm import repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    places = {}
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            places.setdefault(b[i : i + length], []).append((d, i))
    gone = [np.zeros(len(b) + 1, bool) for b in data]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + length] = True
    out = []
    for b, g in zip(data, gone, strict=True):
        rest = bytes(x for x, y in zip(b, g, strict=False) if not y)
        out.append((len(b), int(g.sum()), int((g[1:] & ~g[:-1]).sum() + g[0]), hashlib.sha256(rest).hexdigest()))
    return out


def texts_of(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage = [word(rng.randint(15, 90)) for _ in range(6)]
    texts = [None, "", "a" * 130, "ab" * 60, "a" * 70]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(passage)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : rng.randint(a, len(p))], word(rng.randint(0, 30))]
        texts.append("".join(parts))
    texts += [texts[9], texts[9], texts[12] + "x", "y" + texts[12]]
    for i in range(40):
        texts.append(passage[0] + word(rng.randint(0, 25)) + passage[1][: i % 40])
    return texts


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 4096), (3, 2), (4, 1)])
def test_removed_bytes_equal_brute_force(spark, seed, hot):
    texts = texts_of(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    rows = repeats.remove_repeats(docs, length=24, gram=6, hot=hot).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    want = dict(enumerate(brute(texts, 24)))
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).collect() == []


def collided():
    """Texts whose middle differs but has one polynomial hash."""
    a, b = colliding.pair()
    rng = random.Random(4)
    head, tail = ("".join(rng.choice("bcdefghij ") for _ in range(80)) for _ in range(2))
    return head + a + tail, head + b + tail


def test_colliding_hashes_remove_nothing(spark):
    texts = collided()
    rows = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_bytes=False).collect()
    want = dict(enumerate(brute(texts, 400)))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want
    assert all(w[1] == 0 for w in want.values())


def test_halves_that_collide_are_settled_by_their_bytes():
    a, b = collided()
    c = "x" + a + "y"
    raw = np.frombuffer((a + b + c).encode(), np.uint8)
    n, length, gram = len(a), 400, 8
    at = np.array([60, n + 60, 2 * n + 61])
    far = np.array([60, 60, 61])
    near = far - np.array([n, n, n + 2]) + length
    assert (near >= 0).all()
    item, first, last = repeats.repeated_windows(np.zeros(3, np.uint64), raw, at, near, far, np.ones(3, np.int64), length, gram)
    got = {(i, o) for i, x, y in zip(item, first, last, strict=True) for o in range(x, y + 1)}
    assert got == {(i, o) for i in (0, 2) for o in range(60 - n + length, 61)}


def test_odd_rows(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(3_000_000))
    rows = [(1, long), (2, "z" + long[1_500_000:1_500_600]), (None, "y" * 10 + long[5:500]), (None, None), (3, "same" * 200), (3, "same" * 200), (3, "other")]
    got = sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_bytes=False).collect())
    assert got == [(0, 0, 0, 0), (0, 505, 495, 1), (1, 3_000_000, 1095, 2), (2, 601, 600, 1), (3, 5, 0, 0), (3, 800, 800, 1), (3, 800, 800, 1)]
