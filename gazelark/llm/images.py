"""Copies among images, cropped or edited ones too, by local descriptors.

Each image gives corners at several scales (Harris response, local maxima), each with an orientation (intensity centroid) and a
256-bit string of brightness comparisons turned by it. TABLES words of WORD_BITS of its bits are looked up: joins by (table, word)
tell which images share words, and those that share MIN_SHARED are held against each other whole: features that are nearest to each
other by Hamming distance, MAX_DISTANCE at most, match, and each match says how one image would map to the other: scale, turn and shift. Two images are linked if
enough different features, and enough of all matches, agree on the same of these, in overlapping bins, so that chance matches don't add up.

In the list of a word that more than CROWD features have, two features count as sharing it if all their bits are within MAX_DISTANCE, as
features that match are: every two of the list are held against each other, so none that can match is lost, however
many share the word. In each list every image meets the list's least first, and then every two that are still apart meet: those of a
component that has more than LANE of the list aren't paired with each other, so that edited copies of a picture that a third of all
rows hold cost little, and what is left of a long list is dealt out in lanes, each pair of which meets in a task of its own.

Pixel-identical images are one image throughout. Only features (48 bytes each) are kept and sent, never pixels.

Cases: null, empty or undecodable media and images under MIN_SIDE pixels have no features and are linked by equal bytes only,
null and empty media with nothing; a null key takes no part and has a null class; repeated rows are copies of one image; of rows with one
key and different media each has its own class; large images are described one at a time; features that tie in strength go by place; an empty
table gives an empty result; other columns are ignored.

An image is grey values, row by row, after a header of its width and height (two little-endian 32-bit numbers): the box that
this was built on has no image codecs. as_media() makes it; a decoder for other formats is a parameter.
"""

from __future__ import annotations

import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import components, dropped, small_batches, written

BITS, TABLES, WORD_BITS, MAX_DISTANCE, MIN_VOTES = 256, 4, 32, 40, 6
#: The share of two images' matches that must agree.
MIN_SHARE = 0.25
#: Words that two images must share to be held against each other; features that share a word before their other bits are compared too.
MIN_SHARED, CROWD = 2, 8
#: Rows of a list that meet in one task.
LANE = 1024
RADIUS, TURNS, MIN_SIDE, MOST_FEATURES = 15, 30, 40, 128
SCALES = (1.0, 0.7071, 0.5, 0.3536)


def as_media(pixels: np.ndarray) -> bytes:
    return struct.pack("<II", pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode(media: bytes | None) -> np.ndarray | None:
    """Grey values as floats; None for what isn't an image."""
    if not media or len(media) < 8:
        return None
    width, height = struct.unpack_from("<II", media)
    if width * height != len(media) - 8 or not width:
        return None
    return np.frombuffer(media, np.uint8, offset=8).reshape(height, width).astype(np.float32)


def _blur(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2r+1, edges repeated."""
    n = 2 * r + 1
    sums = np.cumsum(np.pad(x, ((r + 1, r), (0, 0)), mode="edge"), axis=0, dtype=np.float64)
    x = (sums[n:] - sums[:-n]) / n
    sums = np.cumsum(np.pad(x, ((0, 0), (r + 1, r)), mode="edge"), axis=1)
    x = (sums[:, n:] - sums[:, :-n]) / n
    return x


def _scaled(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    h, w = int(x.shape[0] * scale), int(x.shape[1] * scale)
    smooth = _blur(x, 1)
    ys, xs = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(ys.astype(int), 0, x.shape[0] - 2), np.clip(xs.astype(int), 0, x.shape[1] - 2)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    a, b = smooth[y0][:, x0] * (1 - fx) + smooth[y0][:, x0 + 1] * fx, smooth[y0 + 1][:, x0] * (1 - fx) + smooth[y0 + 1][:, x0 + 1] * fx
    return a * (1 - fy) + b * fy


_rng = np.random.default_rng(20240)
_TESTS = np.clip(_rng.normal(0, RADIUS / 2.5, (BITS, 4)), -RADIUS + 4, RADIUS - 4)
_TURNED = np.stack([np.stack([_TESTS[:, [0, 2]] * np.cos(t) - _TESTS[:, [1, 3]] * np.sin(t), _TESTS[:, [0, 2]] * np.sin(t) + _TESTS[:, [1, 3]] * np.cos(t)], -1) for t in np.arange(TURNS) * 2 * np.pi / TURNS]).round().astype(int)  # turn, test, point, (x, y)
_PICKED = np.stack([_rng.choice(BITS, 80, replace=False)[:WORD_BITS] for _ in range(TABLES)])
_FEATURE = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("turn", "<f4"), ("bits", "<u8", BITS // 64)])
_dy, _dx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_dx**2 + _dy**2 <= RADIUS**2).astype(np.float32)


def features(image: np.ndarray | None, most: int = MOST_FEATURES) -> np.ndarray:
    """The strongest corners as _FEATURE; x and y in the image's own pixels."""
    out = []
    if image is not None and min(image.shape) >= MIN_SIDE:
        for scale in SCALES:
            x = _scaled(image, scale)
            if min(x.shape) < 2 * RADIUS + 3:
                break
            gy, gx = np.gradient(_blur(x, 1))
            a, b, c = _blur(gx * gx, 2), _blur(gy * gy, 2), _blur(gx * gy, 2)
            strength = a * b - c * c - 0.05 * (a + b) ** 2
            inner = strength[RADIUS:-RADIUS, RADIUS:-RADIUS]
            around = np.full_like(inner, -np.inf)
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    if i or j:
                        np.maximum(around, strength[RADIUS + i : strength.shape[0] - RADIUS + i, RADIUS + j : strength.shape[1] - RADIUS + j], out=around)
            ys, xs = np.nonzero((inner > around) & (inner > 1.0))
            best = np.argsort(-inner[ys, xs], kind="stable")[: int(most * scale)]
            ys, xs = ys[best] + RADIUS, xs[best] + RADIUS
            if not len(ys):
                continue
            patches = x[ys[:, None, None] + _dy, xs[:, None, None] + _dx] * _DISC
            angle = np.arctan2((patches * _dy).sum((1, 2)), (patches * _dx).sum((1, 2)))
            turn = np.round(angle * TURNS / (2 * np.pi)).astype(int) % TURNS
            smooth = _blur(x, 2)
            points = _TURNED[turn]
            values = smooth[np.clip(ys[:, None, None] + points[..., 1], 0, x.shape[0] - 1), np.clip(xs[:, None, None] + points[..., 0], 0, x.shape[1] - 1)]
            found = np.zeros(len(ys), _FEATURE)
            found["x"], found["y"], found["scale"], found["turn"] = xs / scale, ys / scale, scale, turn * (2 * np.pi / TURNS)
            found["bits"] = np.packbits(values[:, :, 0] < values[:, :, 1], axis=1).view("<u8")
            out.append(found)
    return np.concatenate(out) if out else np.zeros(0, _FEATURE)


def words(found: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The word, with its table, of each feature (row) in each of these tables (column)."""
    tests = np.unpackbits(np.ascontiguousarray(found["bits"]).view(np.uint8).reshape(len(found), BITS // 8), axis=1).astype(np.int64)
    return (tests[:, _PICKED[tables]] @ (1 << np.arange(WORD_BITS))) * TABLES + tables


def agree(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether MIN_VOTES different features of a and of b, and MIN_SHARE of those that match, agree on scale, turn and shift."""
    if min(len(a), len(b)) < MIN_VOTES:
        return False
    distance = np.bitwise_count(a["bits"][:, None] ^ b["bits"][None]).sum(axis=2, dtype=np.int64)
    # those that are nearest to each other
    near = (distance <= MAX_DISTANCE) & (distance == distance.min(axis=1, keepdims=True)) & (distance == distance.min(axis=0, keepdims=True))
    i, j = np.nonzero(near)
    if len(i) < MIN_VOTES:
        return False
    p, q = a[i], b[j]
    ratio = p["scale"].astype(float) / q["scale"]  # how much larger b shows it
    turn = (q["turn"].astype(float) - p["turn"]) % (2 * np.pi)
    size = np.round(np.log2(ratio)).astype(int)
    t = turn / (2 * np.pi / 6)
    u = (q["x"] - ratio * (np.cos(turn) * p["x"] - np.sin(turn) * p["y"])) / 32
    v = (q["y"] - ratio * (np.sin(turn) * p["x"] + np.cos(turn) * p["y"])) / 32
    # each vote counts in both bins that it may share with its like
    for shift in range(8):
        bins = np.stack([size, np.floor(t + (shift & 1) / 2).astype(int) % 6, np.floor(u + (shift >> 1 & 1) / 2).astype(int), np.floor(v + (shift >> 2) / 2).astype(int)], axis=1)
        kinds, back = np.unique(bins, axis=0, return_inverse=True)
        count = [np.bincount(np.unique(back.ravel() * len(x) + f) // len(x), minlength=len(kinds)) for f, x in ((i, a), (j, b))]
        if (np.minimum(*count) >= max(MIN_VOTES, MIN_SHARE * len(i))).any():
            return True
    return False


def _described(decoder, most):
    def run(batches):
        for batch in batches:
            known: dict[bytes, bytes] = {}
            for at in range(0, batch.num_rows, 256):
                rows = []
                for key, media in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256), strict=True):
                    media = media.as_py()
                    digest = hashlib.blake2b(media, digest_size=16).digest() if media else None
                    if digest and digest not in known:
                        known[digest] = features(decoder(media), most).tobytes()
                    rows.append((key, digest, known[digest] if digest else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["media", "digest", "features"])

    return run


_BITS = [f"b{i}" for i in range(BITS // 64)]


def _index(batches):
    """(pic, features) to (word, pic), for all tables."""
    for batch in batches:
        for pic, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            word = words(np.frombuffer(packed, _FEATURE), np.arange(TABLES)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.full(len(word), pic))], names=["word", "pic"])


def _index_whole(table: int):
    """(pic, features) to (word, pic, all bits of the feature), for one table."""

    def run(batches):
        for batch in batches:
            for pic, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(packed, _FEATURE)
                bits = found["bits"].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words(found, np.array([table])).ravel()), pa.array(np.full(len(found), pic)), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(_BITS)))], names=["word", "pic", *_BITS])

    return run


def _agreeing(batches):
    """(a, b, features of both) to the (a, b) that agree."""
    for batch in batches:
        a, b, x, y = [batch.column(i).to_pylist() for i in range(4)]
        hits = [k for k in range(len(a)) if agree(np.frombuffer(x[k], _FEATURE), np.frombuffer(y[k], _FEATURE))]
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in hits], pa.int64()), pa.array([b[k] for k in hits], pa.int64())], names=["a", "b"])


def _lists(pics: DataFrame) -> list[DataFrame]:
    """(list, pic, bits) by tables: rows of all words that several images share, with the feature's bits (a row for each) where more than CROWD features have the word, else null.

    Bits come with every word from the first, as many rows as there are features, whichever words turn out to be crowded: how many those
    are grows faster than the table. One table at a time, so that no more of them are on disk at once.
    """
    counts = pics.mapInArrow(_index, "word long, pic long").groupBy("word").agg(F.count("*").alias("n"), F.min("pic").alias("low"), F.max("pic").alias("high"))
    often = written(counts.where("low != high").select("word", "n"))
    out = []
    for table in range(TABLES):
        rows = pics.mapInArrow(_index_whole(table), f"word long, pic long, {', '.join(f'{c} long' for c in _BITS)}").join(often.where(F.pmod("word", F.lit(TABLES)) == table), "word")
        out.append(written(rows.select(F.col("word").alias("list"), "pic", *(F.when(F.col("n") > CROWD, F.col(c)).alias(c) for c in _BITS)).distinct()))
    dropped(often)
    return out


def _held(met: DataFrame, pics: DataFrame) -> DataFrame:
    """(a, b) of the met pairs (a, b, list) that share MIN_SHARED words and agree."""
    pairs = written(met.groupBy("a", "b").agg(F.count_distinct("list").alias("n")).where(F.col("n") >= MIN_SHARED).select("a", "b"))
    side = lambda s: pics.select(F.col("pic").alias(s), F.col("features").alias("f" + s))
    out = written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "fb").mapInArrow(_agreeing, "a long, b long"))
    dropped(pairs)
    return out


def links(pics: DataFrame) -> DataFrame:
    """(a, b): linked images of (pic, features), at least so many that each reaches all that it is linked to."""
    some = pics.where(F.length("features") > 0).select("pic", "features")
    tables = _lists(some)
    lists = functools.reduce(DataFrame.unionByName, tables)
    named = lambda s, *more: [*(F.col(c).alias(c + s) for c in ("part", "pic", *_BITS)), *more]
    near_bits = lambda x, y: F.col(_BITS[0] + x).isNull() | (sum((F.bit_count(F.col(c + x).bitwiseXOR(F.col(c + y))) for c in _BITS), F.lit(0)) <= MAX_DISTANCE)
    least = lists.groupBy("list").agg(F.min(F.struct("pic", *_BITS)).alias("s")).select("list", *(F.col(f"s.{c}").alias(f"{c}_s") for c in ("pic", *_BITS)))
    star = lists.join(least, "list").where((F.col("pic") != F.col("pic_s")) & near_bits("", "_s")).select(F.col("pic_s").alias("a"), F.col("pic").alias("b"), "list")
    first = _held(star, some)
    near = components(first, "a", "b")
    placed = lists.join(near.withColumnRenamed("node", "pic"), "pic", "left").withColumn("part", F.coalesce("component", "pic")).drop("component")
    whole = Window.partitionBy("list")
    placed = placed.select("*", F.min("part").over(whole).alias("low"), F.max("part").over(whole).alias("high"), F.count("*").over(whole).alias("n")).where("low != high")
    rest = written(placed.select("list", "part", "pic", *_BITS, F.ceil(F.col("n") / LANE).cast("int").alias("lanes"), (F.count("*").over(Window.partitionBy("list", "part")) > LANE).alias("large")))
    dropped(*tables, near)
    # a list of several lanes meets by pairs of them, each pair in a task of its own; a component is in one lane
    own = F.pmod(F.xxhash64("part"), F.col("lanes")).cast("int")
    others = lambda a, b: F.explode(F.transform(F.sequence(F.lit(0), F.col("lanes") - 1), lambda i: F.struct(a(i).alias("la"), b(i).alias("lb")))).alias("l")
    sided = lambda s, pick: rest.where("NOT large").select("list", *named(s, pick)).select("*", "l.la", "l.lb").drop("l")
    x, y = sided("_x", others(lambda i: own, lambda i: i)), sided("_y", others(lambda i: i, lambda i: own))
    small = x.join(y, ["list", "la", "lb"]).where((F.col("part_x") < F.col("part_y")) & near_bits("_x", "_y"))
    # a large component meets what isn't its own, two of them once
    large = rest.where("large").select("list", "part").distinct().withColumnRenamed("part", "part_x")
    y = rest.select("list", *named("_y", F.col("large"))).join(large, "list").where("part_x != part_y AND NOT (large AND part_y < part_x)")
    crowds = rest.where("large").select("list", *named("_x")).join(y, ["list", "part_x"]).where(near_bits("_x", "_y"))
    met = small.select("list", "pic_x", "pic_y").unionByName(crowds.select("list", "pic_x", "pic_y"))
    more = _held(met.select(F.least("pic_x", "pic_y").alias("a"), F.greatest("pic_x", "pic_y").alias("b"), "list"), some)
    dropped(rest)
    return first.unionByName(more)


def image_classes(media: DataFrame, column: str = "media", key: str = "media_id", decoder=decode, most: int = MOST_FEATURES) -> DataFrame:
    """(key, class_id, n_features): the least key that each image reaches by copies, and how many features it has."""
    small_batches(media.sparkSession)
    rows = media.select(F.col(key).cast("long").alias("media"), F.col(column).alias("data"))
    every = written(rows.mapInArrow(_described(decoder, most), "media long, digest binary, features binary"))
    pics = every.where("digest IS NOT NULL AND media IS NOT NULL").groupBy("digest").agg(F.min("media").alias("media"), F.first("features").alias("features"))
    pics = written(pics.select(F.monotonically_increasing_id().alias("pic"), "*"))
    slim = written(every.select("media", "digest"))
    dropped(every)
    classes = written(components(links(pics), "a", "b").join(pics.select(F.col("pic").alias("node"), "media", "digest"), "node"))
    least = classes.groupBy("component").agg(F.min("media").alias("class_id"))
    found = classes.join(least, "component").select("digest", "class_id")
    found = pics.select("digest", "media", (F.length("features") / _FEATURE.itemsize).cast("long").alias("n_features")).join(found, "digest", "left").select("digest", F.coalesce("class_id", "media").alias("class_id"), "n_features")
    out = slim.join(found, "digest", "left")
    return out.select(F.col("media").alias(key), F.when(F.col("media").isNotNull(), F.coalesce("class_id", "media")).alias("class_id"), F.coalesce("n_features", F.lit(0)).cast("long").alias("n_features"))


def drawn(vector: list[float] | None, side: int = 96) -> bytes | None:
    """A picture of a vector: each entry weighs a plane wave of its own."""
    if not vector:
        return None
    n = int(np.ceil(np.sqrt(len(vector))))
    waves = np.cos(np.pi * np.outer(5.3 + 1.83 * np.arange(n), (np.arange(side) + 0.5) / side))  # of no common period, so that no picture mirrors itself
    weights = np.zeros(n * n)
    weights[: len(vector)] = np.nan_to_num(np.array(vector, dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
    field = waves.T @ weights.reshape(n, n) @ waves
    low, high = field.min(), field.max()
    return as_media((field - low) * (255 / (high - low) if high > low else 0.0))


def _drawn(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([drawn(v) for v in batch.column(1).to_pylist()], pa.binary())], names=["media_id", "media"])


def op9_image_descriptors(spark, sf_dir: str) -> DataFrame:
    """The tables hold no pictures, so each embedding is drawn as one; then every row of the media column is compared."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return image_classes(vectors.mapInArrow(_drawn, "media_id long, media binary")).withColumnRenamed("media_id", "vec_id")
