import zlib
from itertools import product

import colliding  # beside this file
import numpy as np
import pytest

from gazelark.llm import packing


@pytest.mark.parametrize("counts,room", [({3: 2, 5: 1, 7: 3}, 16), ({10: 1}, 9), ({6: 4, 9: 2, 20: 5}, 44), ({1: 3}, 50), ({}, 5)])
def test_least_slack_is_the_best_subset(counts, room):
    taken = packing.least_slack(counts, room)
    assert all(0 < n <= counts[x] for x, n in taken.items())
    best = max(s for ns in product(*[range(n + 1) for n in counts.values()]) if (s := sum(a * b for a, b in zip(counts, ns, strict=True))) <= room)
    assert sum(x * n for x, n in taken.items()) == best


def test_round_trip(spark):
    texts = [None, "", "A <|endoftext|> b <|STARTOFTEXT|>", "don't STOP now　été 12ab", "x " * 9000, "\x1c a\tb", "İstanbul ΑΣ ς", " ".join(colliding.pair(91)), *["word%d and more, of it!" % i * (i % 90) for i in range(700)]]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(2)
    rows = packing.pack_documents(docs, packing.word_bpe(), block=200).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_bpe())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda x: x["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda x: x["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, packing.word_bpe()).collect() == []


def test_null_keys_repeated_rows_and_very_long_texts(spark):
    long = "word " * 300_000
    rows = [(None, "a b"), (None, "a b"), (3, long), (3, long)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), packing.word_bpe()).collect()
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 6
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == 2 * 300_001
    assert {r["doc_tokens"] for r in got} == {3, 300_001}


def test_kept_words_start_anew(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "KEPT_KINDS", 5)
    ids = packing.Ids(packing.word_bpe())
    for texts in (["one two three"], ["three four five six", "one"], ["Seven one TWO"]):
        flat, bounds = ids(pa.array(texts))
        want = [[*x.tolist(), 1] for x in ids.whole(texts)]
        assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


def test_new_words_are_asked_for_many_at_once():
    import pyarrow as pa

    ids, asked = packing.Ids(packing.word_bpe()), []
    odd = ["it's.", "İstanbul. x.", "é. é! é", "x́.", "≠.", "don't? 'S, ''", "12, 3.5; a.b: ..", "<. <| .", "nbsp a.", "​ ſ. ŉ!", "ΑΣ. ς,", "日本。語.", None, ""]
    texts = odd + [" ".join("abcdefghij"[int(d)] for d in str(i)).replace(" ", "") + ("." if i % 3 else "-x%d" % i) for i in range(5000)]
    want = [[*ids.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    whole = ids.whole
    ids.whole = lambda some: asked.extend(some) or whole(some)
    for some, expected in ((texts, want), ([t for t in texts if "<|" not in (t or "")], [w for t, w in zip(texts, want, strict=True) if "<|" not in (t or "")])):
        asked.clear()
        flat, bounds = ids(pa.array(some, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected
    assert len(asked) < 600, len(asked)  # 5000 words and a chunk of odd ones


def test_words_met_again_stay_kept_when_others_go(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "KEPT_KINDS", 40)
    ids, learned = packing.Ids(packing.word_bpe()), []
    learn = ids._learn
    ids._learn = lambda new: learned.extend(new) or learn(new)
    letters = ["".join("abcdefghij"[int(d)] for d in str(i)) for i in range(300, 600)]
    for i in range(30):
        text = " ".join(["the Quick brown, fox's été 12", *letters[10 * i : 10 * i + 10], letters[0]])
        flat, bounds = ids(pa.array([text, None]))
        assert flat.tolist() == [*ids.whole([text])[0].tolist(), 1, 1] and bounds.tolist() == [0, len(flat) - 1, len(flat)]
        assert len(ids.place) <= 40
    assert len(learned) == len(set(learned)) == 307, len(learned)
