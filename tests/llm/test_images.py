import numpy as np

from gazelark.llm import images


def picture(seed, h=160, w=200):
    rng = np.random.default_rng(seed)
    out = np.full((h, w), 128.0)
    for _ in range(70):
        y, x, a, b = rng.integers(0, h), rng.integers(0, w), rng.integers(8, 40), rng.integers(8, 40)
        out[y : y + a, x : x + b] = rng.integers(0, 256)
    return out


def test_crops_and_edits_are_found_and_others_left_alone(spark):
    rows, want = [], {}
    for seed in range(8):
        base = picture(seed)
        rng = np.random.default_rng(100 + seed)
        kinds = [base, base, base[20:150, 25:190], np.clip(base * 0.8 + 20, 0, 255), np.clip(base + rng.normal(0, 4, base.shape), 0, 255), base[::-1, ::-1]]
        for i, p in enumerate(kinds):
            rows.append((seed * 10 + i, images.as_media(p), "x"))
            want[seed * 10 + i] = seed * 10
    rows += [(900, None, "x"), (901, None, "x"), (902, b"", "x"), (903, b"not an image", "x"), (904, b"not an image", "x"), (905, images.as_media(np.zeros((100, 100))), "x")]
    want |= {900: 900, 901: 901, 902: 902, 903: 903, 904: 903, 905: 905}
    got = {r["media_id"]: r["class_id"] for r in images.image_classes(spark.createDataFrame(rows, "media_id long, media binary, class_id string")).collect()}
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert set(got) == set(want) and len(wrong) <= 2, wrong  # a copy in ten may be missed
    assert all(got[k] // 10 == k // 10 for k in got)  # none is taken for another's copy


def test_empty_table(spark):
    assert images.image_classes(spark.createDataFrame([], "media_id long, media binary")).collect() == []


def test_turned_and_noisy_copies_of_drawn_vectors_are_found(spark):
    rows, rng = [], np.random.default_rng(11)
    for i in range(20):
        base = images.decode(images.drawn(rng.normal(size=64).tolist()))
        kinds = [base, np.rot90(base), np.clip(base + rng.normal(0, 20, base.shape), 0, 255)]
        rows += [(i * 10 + j, images.as_media(p)) for j, p in enumerate(kinds)]
    got = {r["media_id"]: r["class_id"] for r in images.image_classes(spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    assert all(got[k] // 10 == k // 10 for k in got)
    assert sum(got[k] == k - k % 10 for k in got if k % 10) >= 28  # of 40


def packed(bits, places):
    out = np.zeros(len(places), images._FEATURE)
    out["bits"], out["x"], out["y"], out["scale"] = bits, [x for x, _ in places], [y for _, y in places], 1.0
    return out


def pics_of(spark, found):
    return spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(found)], "pic long, features binary")


def reached(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_copies_whose_words_are_all_crowded_are_found(spark):
    rng, found = np.random.default_rng(3), []
    bits = rng.integers(0, 1 << 62, (8, 4))
    places = [rng.integers(0, 100_000, (8, 2)).tolist() for _ in range(40)]
    found = [packed(bits, p) for p in places + places]
    got = {(r["a"], r["b"]) for r in images.links(pics_of(spark, found)).collect()}
    assert got == {(i, 40 + i) for i in range(40)}


def test_pairs_whose_crowded_words_differ_beyond_their_bits_are_found(spark, monkeypatch):
    rng = np.random.default_rng(4)
    free = np.setdiff1d(np.arange(images.BITS), images._PICKED[:, : images.WORD_BITS])  # bits of no word
    base = rng.integers(0, 2, (8, images.BITS)).astype(np.uint8)
    found, partners = [], []
    for _ in range(40):
        place = rng.integers(0, 100_000, (8, 2)).tolist()
        for to in (found, partners):
            tests = base.copy()
            tests[:, rng.choice(free, 18, replace=False)] ^= 1
            to.append(packed(np.packbits(tests, axis=1).view("<u8"), place))
    want = {(i, 40 + i) for i in range(40)}
    pics = pics_of(spark, found + partners)
    assert {(r["a"], r["b"]) for r in images.links(pics).collect()} == want
    # lists of many lanes, and components of more than a lane
    monkeypatch.setattr(images, "LANE", 7, raising=False)
    copies = pics_of(spark, found + partners + [found[0]] * 10)
    got = {(r["a"], r["b"]) for r in images.links(copies).collect()}
    label = reached(90, got)
    assert [label[i] for i in range(40, 80)] == list(range(40)) and label[80:] == [0] * 10


def test_recall_against_all_pairs_is_above_nine_tenths(spark):
    rng, found = np.random.default_rng(17), []
    for _ in range(16):
        base = images.decode(images.drawn(rng.normal(size=64).tolist()))
        found += [base, base[6:90, 4:92], np.rot90(base), np.clip(base * 0.8 + 25, 0, 255), np.clip(base + rng.normal(0, 12, base.shape), 0, 255), images._blur(base, 1)]
    found = [images.features(images.decode(images.as_media(p))) for p in found]
    want = {(a, b) for a in range(len(found)) for b in range(a + 1, len(found)) if images.agree(found[a], found[b])}
    assert len(want) >= 100
    got = {(r["a"], r["b"]) for r in images.links(pics_of(spark, found)).collect()}
    label = reached(len(found), got)
    assert got <= want and sum(label[a] == label[b] for a, b in want) >= 0.9 * len(want)
    assert label == reached(len(found), want)


def test_repeated_rows_large_images_and_keys_of_two_images(spark):
    a, b = images.as_media(picture(1, 700, 900)), images.as_media(picture(2))
    rows = [(5, a), (5, a), (5, b), (9, b), (None, a), (7, images.as_media(picture(1, 700, 900)[100:600, 50:800]))]
    got = sorted(((r["media_id"] or 0, r["class_id"]) for r in images.image_classes(spark.createDataFrame(rows, "media_id long, media binary")).collect()), key=repr)
    assert got == [(0, None), (5, 5), (5, 5), (5, 5), (7, 5), (9, 5)]


def test_rows_of_the_lists_follow_the_images_however_many_words_are_crowded(spark, monkeypatch):
    rng = np.random.default_rng(5)
    bits, places = rng.integers(0, 1 << 62, (8, 4)), rng.integers(0, 100_000, (8, 2)).tolist()
    pics = pics_of(spark, [packed(bits, places)] * (5 * images.CROWD))
    made, run = [], type(pics).mapInArrow
    monkeypatch.setattr(type(pics), "mapInArrow", lambda df, f, schema, *more: made[-1].append((out := run(df, f, schema, *more)).count()) or out)
    for n in (images.CROWD, 5 * images.CROWD):
        made.append([])
        images._lists(pics.where(f"pic < {n}"))
    assert made[1] == [5 * n for n in made[0]], made
