import math
import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from gazelark.llm import langid

VOCAB = {"aa": ["the", "there", "what", "with", "nothing"], "bb": ["être", "leaux", "quoi", "tion", "aient"], "cc": ["sch", "für", "keit", "ungen", "über"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(VOCAB[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_mixtures_and_odd_texts(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, lang := rng.choice(list(VOCAB)), rng.randint(3, 60)), lang, i % 4 == 2, 9) for i in range(400)]
    odd = [(1000, None, "aa", True, 1), (1001, "", None, True, 1), (1002, "12 !? 3", "bb", True, 1), (1003, sentence(rng, "aa", 30) + " " + sentence(rng, "cc", 70), None, True, 1), (1003, "the there", None, True, 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, out boolean, score int")
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["held_out"]) for r in langid.identify(docs, F.col("out")).collect()]
    assert len(got) == len(rows) + len(odd)
    pred = {d: (p, s) for d, p, s, _ in got}
    held = [r for r in rows if r[3]]
    assert sum(pred[r[0]][0] == r[2] for r in held) >= 0.97 * len(held)
    assert pred[1000] == pred[1001] == pred[1002] == ("und", 0.0)
    mixture = max((s for d, p, s, _ in got if d == 1003 and p == "cc"), default=0)
    assert 0.5 < mixture < 0.9


def test_nothing_learned_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(docs, F.lit(False)).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0), F.lit(False)).collect() == []


def plain_em(like, chosen):
    """(proportions, log likelihood) of one document by expectation-maximisation in plain Python."""
    share = {j: 1 / len(chosen) for j in chosen}
    for _ in range(400):
        fresh = dict.fromkeys(chosen, 0.0)
        for word in like:
            total = sum(word[j] * share[j] for j in chosen)
            for j in chosen:
                fresh[j] += word[j] * share[j] / total / len(like)
        share = fresh
    return share, sum(math.log(sum(word[j] * share[j] for j in chosen)) for word in like)


def test_sets_of_languages_are_the_best_of_all_sets():
    rng = np.random.default_rng(5)
    k, n = 5, 20
    model = langid.Model([f"l{i}" for i in range(k)], np.ones((langid.BUCKETS, k)))
    logs, row = [], []
    for doc in range(n):  # 1 to 5 languages
        truth = rng.choice(k, 1 + doc % 5, replace=False)
        for w in range(40):
            own = rng.normal(-9, 0.6, k)
            own[truth[w % len(truth)]] += 4
            logs.append(own)
            row.append(doc)
    logs, row = np.array(logs), np.array(row)
    share = model.mixtures(logs, row, n)
    assert {int((x > 0).sum()) for x in share} >= {1, 2, 3, 4}
    for doc in range(n):
        like = np.exp(logs[row == doc])
        best = max((plain_em(like.tolist(), c) for size in range(1, k + 1) for c in combinations(range(k), size)), key=lambda x: x[1] - 0.5 * (len(x[0]) - 1) * math.log(40)) if doc < 5 else None
        if best:
            assert set(np.flatnonzero(share[doc])) == set(best[0])
            assert all(abs(share[doc][j] - p) < 0.02 for j, p in best[0].items())


def test_mixture_is_given_and_ties_go_by_name(spark):
    docs = spark.createDataFrame([(1, "aa bb", "y", False), (2, "aa bb", "x", False), (3, "aa bb " * 100_000, None, True), (None, "aa", None, True)], "doc_id long, text string, lang string, out boolean")
    rows = {r["doc_id"]: r for r in langid.identify(docs, F.col("out")).collect()}
    assert rows[3]["lang_pred"] == rows[None]["lang_pred"] == "x" and rows[3]["mixture"] == "x:1.000"
