"""Removal of long repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of `length` bytes covers it that starts anywhere else too. Sorting every suffix isn't needed to
find those strings: the least hashed `gram`-byte string in each window of `length` bytes is its anchor, so equal windows have
equal anchors, about one for 180 bytes. Windows with one anchor form a run of starts, told by offsets before the anchor.

1. All runs are counted by their anchor's gram and by a 128-bit BLAKE2b digest of the whole stretch that their windows
   cover (the hull). A gram that occurs once settles a run as unique, a hull that occurs twice settles it as repeated.
2. Of what is left, one row for each hull goes with its stretch of text to the task of its gram. There runs are halved: the
   bytes that all windows of a half share (its core) and its hull are hashed as prefix polynomials and counted again, and halves with
   equal hulls are compared byte by byte, until a half is settled or STEP windows wide.
3. The suffixes that start in those last windows are sorted. A comparison finds the common extension of two suffixes by
   binary search over prefix hashes, compares the bytes up to there to rule out a collision, and then one byte more. Neighbours
   with a common extension of `length` bytes or more are repeats.

A polynomial's collision can only send a stretch further down these steps: nothing is removed but by a digest or by bytes.
A gram with more than HOT different stretches isn't sent to one task: its runs are cut into parts of WIDTHS[0] windows, which go
through the same steps grouped by their cores, nearly whole windows; and those of a core with as many different parts are cut into
single windows, which are only counted. So a passage that a third of all documents hold in different surroundings needs no room anywhere.

Cases: null and empty texts have no bytes; texts shorter than `length` lose nothing; a very long text is cut into overlapping
chunks of CHUNK windows; repeated rows are documents of their own and so repeat each other; rows with equal or null keys are told apart by their
text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, mixed, slices, string_bytes, written

LENGTH, GRAM = 400, 32
#: Windows in a part that is sorted; different stretches above which a gram's windows are counted one by one; bytes that a task hashes at once.
STEP, HOT, CHUNK = 4, 4096, 1 << 19
#: Windows in a part of a crowded gram's run, and of a crowded part's.
WIDTHS = (24, 1)
_PLACE = np.uint64((1 << 30) - 1)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_power_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i < n."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _power_cache:
        _power_cache.clear()
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _power_cache[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _power_cache[size]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """sums, with which span() hashes any stretch."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw) + 1)[0][: len(raw)], out=sums[1:])
    return sums


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of so many entries."""
    n = len(v)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """(row, place, first window, last window, gram hash) of each run; windows lie within rows."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none.astype(np.uint64)
    sums = prefix_hashes(raw)
    at = np.arange(len(raw) - gram + 1)
    grams = span(sums, at, at + gram)
    del sums
    # the rightmost of equal grams, so that the choice depends on the window alone
    least = _least((grams & ~_PLACE) | (_PLACE - (at.astype(np.uint64) & _PLACE)), length - gram + 1)
    place = (_PLACE - (least & _PLACE)).astype(np.int64)
    row = np.searchsorted(starts, np.arange(len(place)), side="right") - 1
    window = np.flatnonzero(np.arange(len(place)) + length <= starts[row + 1])
    if not len(window):
        return none, none, none, none, none.astype(np.uint64)
    place, row = place[window], row[window]
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    p = place[first]
    return row[first], p, window[first], window[last], grams[p]


def _digests(data: bytes | memoryview, begin: list[int], end: list[int]) -> np.ndarray:
    """128-bit digests of stretches, as pairs of 64-bit numbers."""
    parts = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(begin, end, strict=True)]
    return np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)


def _chunks(batches, text: int, length: int):
    """(batch, bytes, row starts, bytes before them): pieces of rows, and of rows longer than CHUNK."""
    for piece in slices(batches, text, CHUNK):
        raw, starts = string_bytes(piece.column(text))
        if len(raw) <= 2 * CHUNK:
            yield piece, raw, starts, 0
        else:  # a single row
            for at in range(0, max(len(raw) - length + 1, 1), CHUNK):
                part = raw[at : at + CHUNK + length - 1]
                yield piece, part, np.array([0, len(part)]), at


def _runs(length: int, gram: int):
    """(key_a, key_b, text) to a row for each run; `at` has its anchor's place and the offsets of its windows before that."""

    def run(batches):
        for piece, raw, starts, before in _chunks(batches, 2, length):
            r, p, low, high, g = anchors(raw, starts, length, gram)
            if len(r):
                hull = _digests(raw.tobytes(), low.tolist(), (high + length).tolist())
                at = (p - starts[r] + before) << 32 | (p - high) << 16 | (p - low)
                keys = [piece.column(i).to_numpy(zero_copy_only=False)[r] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, at, np.ones(len(at), np.int64), g.view(np.int64), hull[:, 0], hull[:, 1])], names=["key_a", "key_b", "at", "copies", "group", "hull_a", "hull_b"])

    return run


def _needed(batches, most: int):
    """Rows (key_a, key_b, text, runs) in batches of the needed stretches, each at most so many runs: lists by column."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for key_a, key_b, text, runs in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            data = text.encode() if isinstance(text, str) else text
            for one in runs:
                at = one["at"]
                for c, v in zip(columns, (key_a, key_b, data, at, one["copies"], one["group"]), strict=True):
                    c.append(v)
                if len(columns[0]) >= most:
                    yield columns
                    columns = [[] for _ in range(6)]
        if columns[0]:
            yield columns


def _unpacked(at: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, near, far)"""
    x = np.array(at, np.int64)
    return x >> 32, x >> 16 & 0xFFFF, x & 0xFFFF


def _stretches(length: int):
    """Rows (key_a, key_b, text, runs) to one row for each run: what its windows cover."""

    def run(batches):
        for a, b, data, at, copies, group in _needed(batches, 2048):
            place, near, far = _unpacked(at)
            begin, end = (place - far).tolist(), (place - near + length).tolist()
            stretch = [d[x:y] for d, x, y in zip(data, begin, end, strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (a, b, at, copies, group)], pa.array(stretch, pa.binary())], names=["key_a", "key_b", "at", "copies", "group", "stretch"])

    return run


def _parts(length: int, gram: int, width: int):
    """Rows (key_a, key_b, text, runs) to a row for each part of each run: runs of their own, grouped by what all windows of the part share."""

    def run(batches):
        for a, b, data, at, copies, _ in _needed(batches, 4096 if width > 1 else 256):
            columns: list[list] = [[] for _ in range(5)]
            hulls, cores = [], []
            for i, (place, near, far) in enumerate(zip(*[x.tolist() for x in _unpacked(at)], strict=True)):
                lows = [lo for lo in range(near - near % width, far + 1, width)]
                ends = [(max(lo, near), min(lo + width - 1, far)) for lo in lows]
                hulls.append(_digests(data[i], [place - y for _, y in ends], [place - x + length for x, _ in ends]))
                # of the part as it is in any run, whichever of its windows this one has
                cores.append(_digests(data[i], [place - lo for lo in lows], [max(place + gram, place - lo - width + 1 + length) for lo in lows]) if width > 1 else hulls[-1])
                for c, v in zip(columns, ([a[i]] * len(lows), [b[i]] * len(lows), [place << 32 | x << 16 | y for x, y in ends], [copies[i]] * len(lows), lows), strict=True):
                    c += v
            hull, core = np.concatenate(hulls), np.concatenate(cores)[:, 0]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(core ^ np.array(columns[4], np.int64)), pa.array(hull[:, 0]), pa.array(hull[:, 1])], names=["key_a", "key_b", "at", "copies", "group", "hull_a", "hull_b"])

    return run


def common_extension(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes from a and from b share, up to most, by binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) // 2
        same = span(sums, a, a + mid) == span(sums, b, b + mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)


def repeated_windows(groups: np.ndarray, raw: np.ndarray, at: np.ndarray, near: np.ndarray, far: np.ndarray, copies: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first offset, last offset) of the windows that another stretch of the group has too, or another copy of it.

    Stretch i has its anchor at raw[at[i]] and windows that start far[i] to near[i] bytes before it.
    """
    sums, data = prefix_hashes(raw), raw.tobytes()
    found = _halved(groups, sums, data, at, near, far, copies, length, gram, True)
    if found is None:  # equal hashes of different bytes: no half is settled by them, and the sort decides on all
        found = _halved(groups, sums, data, at, near, far, copies, length, gram, False)
    return found


def _halved(groups, sums, data, at, near, far, copies, length, gram, settle):
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    top = 1 << (length - gram + 1).bit_length()
    item, lo, hi = np.arange(len(at)), np.zeros(len(at), np.int64), np.full(len(at), top - 1)
    group = groups.astype(np.uint64)

    def twice(key: np.ndarray, weight: np.ndarray) -> np.ndarray:
        _, back = np.unique(key, return_inverse=True)
        return np.bincount(back, weights=weight)[back] > 1

    while len(item):
        width = hi[0] - lo[0] + 1
        a, b = np.maximum(lo, near[item]), np.minimum(hi, far[item])
        start, end = at[item] - b, at[item] - a + length  # of the hull
        # what all windows of the part share; every stretch that has one of them has it
        core_a = at[item] - lo
        core_b = np.maximum(at[item] + gram, at[item] - hi + length)
        core = mixed(span(sums, core_a, core_b) ^ group)
        weight = copies[item].astype(float)
        hull = mixed(span(sums, start, end) ^ mixed(group + (a * 1024 + b).astype(np.uint64)))
        settled = twice(hull, weight) & settle
        unique = ~twice(core, weight)
        _, one, same = np.unique(hull, return_index=True, return_inverse=True)
        for i in np.flatnonzero(settled):
            j = one[same[i]]
            if data[start[i] : end[i]] != data[start[j] : end[j]]:
                return None
        done = settled & ~unique
        if done.any():
            found.append((item[done], a[done], b[done]))
        # a settled part stays as a partner of others, one for each hull
        keep = np.zeros(len(item), bool)
        keep[one] = True
        open_ = ~settled & ~unique
        _, back = np.unique(core, return_inverse=True)
        wanted = np.bincount(back, weights=open_)[back] > 0
        stay = (open_ | (settled & keep)) & wanted
        item, lo, hi, group = item[stay], lo[stay], hi[stay], core[stay]
        if width <= STEP:
            break
        half = width // 2
        item, lo, hi, group = np.tile(item, 2), np.concatenate([lo, lo + half]), np.concatenate([lo + half - 1, hi]), np.tile(group, 2)
        some = np.maximum(lo, near[item]) <= np.minimum(hi, far[item])
        item, lo, hi, group = item[some], lo[some], hi[some], group[some]
    if len(item):
        found.append(_sorted_repeats(sums, data, group, item, lo, hi, at, near, far, copies, length))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sorted_repeats(sums, data, group, item, lo, hi, at, near, far, copies, length):
    """The last step: the suffixes that start in the remaining windows, sorted within (group, offset)."""
    offsets = [lo + k for k in range(int((hi - lo).max()) + 1)]
    fits = [(o <= hi) & (o >= near[item]) & (o <= far[item]) for o in offsets]
    which = np.concatenate([np.flatnonzero(f) for f in fits])
    offset = np.concatenate([o[f] for o, f in zip(offsets, fits, strict=True)])
    key, owner = group[which], item[which]
    suffix = at[owner] - offset
    order = np.lexsort((offset, key))
    key, owner, offset, suffix = key[order], owner[order], offset[order], suffix[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (offset[1:] != offset[:-1])
    bounds = np.append(np.flatnonzero(new), len(key))
    sizes = np.diff(bounds)
    hit = copies[owner] > 1

    def check(x: np.ndarray, y: np.ndarray) -> None:
        """Mark the suffix pairs with a common extension of the whole length, whose bytes are equal."""
        same = common_extension(sums, suffix[x], suffix[y], np.full(len(x), length)) >= length
        for i, j in zip(x[same], y[same], strict=True):
            if data[suffix[i] : suffix[i] + length] == data[suffix[j] : suffix[j] + length]:
                hit[i] = hit[j] = True

    pairs = bounds[:-1][sizes == 2]
    if len(pairs):
        check(pairs, pairs + 1)
    for first, size in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):

        def compare(i: int, j: int) -> int:
            n = int(common_extension(sums, suffix[i : i + 1], suffix[j : j + 1], np.array([length]))[0])
            x, y = data[suffix[i] : suffix[i] + length], data[suffix[j] : suffix[j] + length]
            if x[:n] != y[:n]:  # a collision
                return -1 if x < y else 1
            return 0 if n >= length else x[n] - y[n]

        ranked = np.array(sorted(range(first, first + size), key=cmp_to_key(compare)))
        check(ranked[:-1], ranked[1:])
    return owner[hit], offset[hit], offset[hit]


def _settled(length: int, gram: int):
    """Stretches sorted by group to the repeated windows of each; a group may go over several batches, and has HOT rows at most."""
    names = ["key_a", "key_b", "start", "end"]

    def solve(table: pa.Table):
        column = table.column("stretch").combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
        raw, starts = string_bytes(column)
        value = lambda name: table.column(name).to_numpy()
        place, near, far = _unpacked(value("at"))
        item, a, b = repeated_windows(value("group").view(np.uint64), raw, starts[:-1] + far, near, far, value("copies"), length, gram)
        return pa.RecordBatch.from_arrays([pa.array(value("key_a")[item]), pa.array(value("key_b")[item]), pa.array(place[item] - b), pa.array(place[item] - a + length)], names=names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, limit = 0, CHUNK
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < limit:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            groups = table.column("group").to_numpy()
            start = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
            if start:
                yield solve(table.slice(0, start))
            held = table.slice(start).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
            limit = max(CHUNK, 2 * size)
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _kept(with_bytes: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_bytes

    def run(batches):
        for batch in batches:
            columns = [[] for _ in names]
            for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                pieces, runs, last = [], 0, 0
                for s in sorted(spans or (), key=lambda x: x["start"]):
                    if s["start"] > last or not runs:
                        pieces.append(data[last : s["start"]])
                        runs += 1
                    last = max(last, s["end"])
                rest = b"".join([*pieces, data[last:]])
                for c, v in zip(columns, (key, len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest), strict=False):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


_SPANS = "key_a long, key_b long, start long, end long"


def _keyed(key: str, text: str):
    """A row's identity: 128 bits of its key and text."""
    return F.xxhash64(F.col(key), F.col(text)).alias("key_a"), F.xxhash64(F.lit(5), F.col(text), F.col(key)).alias("key_b")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(key_a, key_b, spans): for each (key_a, key_b, text) with repeats, the covered stretches, which may overlap."""
    if length >= 1 << 16:
        raise ValueError("length must be below 65536")
    kinds = "key_a long, key_b long, at long, copies long, group long, hull_a long, hull_b long"
    rest, runs = [], docs.mapInArrow(_runs(length, gram), kinds)
    for width in (*WIDTHS, 0):
        settled, need, used = _level(runs, length)
        few = _texts_of(docs, need.where(F.col("contexts") <= hot))
        stretches = few.mapInArrow(_stretches(length), "key_a long, key_b long, at long, copies long, group long, stretch binary")
        dealt = stretches.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group")
        before, rest = rest, [written(reduce(DataFrame.unionByName, [*rest, settled, dealt.mapInArrow(_settled(length, gram), _SPANS)]))]
        dropped(*before)
        crowded = need.where(F.col("contexts") > hot)
        if crowded.isEmpty():
            dropped(need, *used)
            break
        runs = written(_texts_of(docs, crowded).mapInArrow(_parts(length, gram, width), kinds))
        dropped(need, *used)
    spans = written(rest[0].groupBy(*_KEYS).agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    dropped(*rest)
    return spans


_KEYS, _HULL = ["key_a", "key_b"], ["hull_a", "hull_b"]


def _level(runs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(spans that equal hulls settle, one run for each hull of the groups that are open, tables that the spans are read from)."""
    counted = written(runs)
    # written, so that a group of many runs can be split where it is joined; dealt by key at every size, as these tables grow with the data
    often = written(counted.groupBy("group").agg(F.sum("copies").alias("n")).where("n > 1").select("group"))
    maybe = written(counted.join(often.hint("merge"), "group", "left_semi"))
    dropped(counted, often)
    # any of a hull's runs stands for it
    hulls = written(maybe.groupBy(*_HULL, "group").agg(F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in (*_KEYS, "at")]))
    open_ = written(hulls.groupBy("group").agg(F.count("*").alias("contexts"), F.min("copies").alias("least")).where("least = 1 AND contexts > 1").select("group", "contexts"))
    need = written(hulls.join(open_.hint("merge"), "group").select("group", "contexts", "copies", *_KEYS, "at"))
    dropped(open_)
    place, near, far = F.shiftright("at", 32), F.shiftright("at", 16).bitwiseAND(F.lit(0xFFFF)), F.col("at").bitwiseAND(F.lit(0xFFFF))
    settled = maybe.join(hulls.where("copies > 1").select(*_HULL).hint("merge"), _HULL, "left_semi").select(*_KEYS, (place - far).alias("start"), (place - near + length).alias("end"))
    return settled, need, [maybe, hulls]


def _texts_of(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(key_a, key_b, text, runs) of the documents with needed runs."""
    runs = need.groupBy(*_KEYS).agg(F.collect_list(F.struct("at", "copies", "group")).alias("runs"))
    return docs.join(runs, _KEYS).select(*_KEYS, "text", "runs")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_bytes: bool = True) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept): kept are the bytes left of each text, given if with_bytes."""
    keyed = docs.select(*_keyed(key, text), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    spans = repeated_spans(keyed.select("key_a", "key_b", "text"), length, gram, hot)
    out = keyed.join(spans, ["key_a", "key_b"], "left").select(F.col("doc_id").cast("long"), "text", "spans")
    return out.mapInArrow(_kept(with_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes).withColumnRenamed("doc_id", key)


def op5_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_bytes=False)
