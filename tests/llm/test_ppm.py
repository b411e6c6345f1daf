import math
import random
import re
from collections import Counter, defaultdict

import colliding  # beside this file
import numpy as np
import pytest
from pyspark.sql import functions as F

from gazelark.llm import ppm
from gazelark.llm._shared import fold

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def brute(texts, held, order):
    counts = defaultdict(Counter)
    uni = Counter()
    symbols = lambda text: [254, *(text or "").translate(LOW).encode(), 255]
    for text, out in zip(texts, held, strict=True):
        if out:
            continue
        uni.update([*tokens(text), None])
        s = symbols(text)
        for i in range(1, len(s)):
            for k in range(min(order, i) + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1

    def code(text):
        s, total = symbols(text), 0.0
        for i in range(1, len(s)):
            gone = set()
            for k in range(min(order, i), -1, -1):
                own = {x: n for x, n in counts.get(tuple(s[i - k : i]), {}).items() if x not in gone}
                if not own:
                    continue
                n, t = sum(own.values()), len(own)
                if s[i] in own:
                    total += math.log10(own[s[i]] / (n + t))
                    break
                total += math.log10(t / (n + t))
                gone |= set(own)
            else:
                total -= math.log10(256 - len(gone))
        return total

    n, v = sum(uni.values()), len(uni)
    rows = []
    for text in texts:
        ws = [*tokens(text), None]
        rows.append((len(ws), sum(uni[w] > 0 for w in ws), n, sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), code(text)))
    return rows


@pytest.mark.parametrize("most", [3, 1 << 18])
def test_scores_equal_brute_force(spark, most):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = [None, "", " \t\n", "A a B", "zzz zzz \x00 😀"] + [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    texts += [texts[7]] * 3 + list(colliding.pair(91)) + [" ".join(reversed(texts[9].split()))]
    held = [i % 3 == 0 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, h, 1.0) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, held boolean, score double")
    got = {r["doc_id"]: r for r in ppm.ppm_scores(docs, F.col("held"), order=4, most_words=most, most_tops=most).collect()}
    for i, want in enumerate(brute(texts, held, 4)):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert r["base_score"] == pytest.approx(want[3], abs=1e-6)
        assert r["score"] == pytest.approx(want[4], abs=1e-6)


@pytest.mark.parametrize("order", [0, 1, 6])
def test_scores_of_short_and_long_contexts_equal_brute_force(spark, order):
    rng = random.Random(8)
    texts = [None, "", "zzz zzz \x00 😀", "A a"] + [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(9)) for _ in range(30)]
    held = [i % 3 == 0 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, held boolean")
    got = {r["doc_id"]: r["score"] for r in ppm.ppm_scores(docs, F.col("held"), order=order).collect()}
    for i, want in enumerate(brute(texts, held, order)):
        assert got[i] == pytest.approx(want[4], abs=1e-6)


def test_no_rows_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.ppm_scores(empty, F.lit(False)).collect() == []
    one = spark.createDataFrame([(1, "ab"), (1, "ab")], "doc_id long, text string")
    rows = ppm.ppm_scores(one, F.lit(True)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows] == [(2, 0, 0)] * 2
    assert rows[0]["score"] == pytest.approx(-3 * math.log10(256))


def test_null_keys_and_very_long_texts(spark):
    long = "ab cd " * 400_000 + "x" * 300_000
    docs = spark.createDataFrame([(None, "ab"), (None, "ab"), (3, long)], "doc_id long, text string")
    rows = sorted(ppm.ppm_scores(docs, fold("doc_id", 10) == 0).collect(), key=lambda r: r["n_tokens"])
    assert [(r["doc_id"], r["held_out"], r["n_tokens"]) for r in rows] == [(None, False, 2), (None, False, 2), (3, False, 800_002)]
    assert rows[0] == rows[1] and rows[2]["score"] < rows[0]["score"] < 0


def test_scores_see_the_order_of_words(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one two three four"] * 9 + ["four two three one"])], "doc_id long, text string")
    scores = {r["doc_id"]: (r["base_score"], r["score"]) for r in ppm.ppm_scores(docs, F.col("doc_id") == 9).collect()}
    assert scores[9][0] == pytest.approx(scores[0][0]) and scores[9][1] < scores[0][1] - 1


def test_a_task_adds_up_its_equal_tops(monkeypatch):
    import pyarrow as pa

    texts = ["the same words over and over", "", None, "other ones", "é and the same"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts * 4, pa.string()), pa.array([True, True, False, False, True] * 4)], names=["text", "train"])
    tops = lambda some: ppm._tops(*ppm.string_bytes(pa.array(some, pa.string())), 5)[0].view(np.int64).tolist()
    want = dict.fromkeys(tops(texts), 0)
    for t in tops([texts[0], texts[1], texts[4]]):
        want[t] += 4 * 30
    rows = [r for b in ppm._count_tops(5)(iter([batch] * 30)) for r in b.to_pylist()]
    assert len(rows) == len(want) and {r["top"]: r["n"] for r in rows} == want
    monkeypatch.setattr(ppm, "GATHERED", 70)
    got = dict.fromkeys(want, 0)
    for b in ppm._count_tops(5)(iter([batch] * 30)):
        for r in b.to_pylist():
            got[r["top"]] += r["n"]
    assert got == want
    assert list(ppm._count_tops(5)(iter([]))) == []
