"""What the operators of this subpackage share: written tables, Arrow columns, word hashes and components."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as a Java and as a DuckDB pattern.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes in a batch that goes to a Python worker, where the session doesn't say less.
BATCH_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where none is set on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="gazelark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/gazelark-{spark.sparkContext.applicationId}"


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, from here on in this session."""
    now = spark.conf.get(_BATCH, None)
    if now is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage and outlives executors.

    The shuffle files that made it go when it is written.
    """
    spark = df.sparkSession
    if getattr(df, "_gazelark_path", None):
        return df
    small_batches(spark)
    path = f"{_run_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._gazelark_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean(spark: SparkSession) -> None:
    """Remove all tables that this application's queries have written, once their results are no longer read."""
    _remove(spark, _run_folder(spark))


def dropped(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_gazelark_path", None)
        if path:
            _remove(df.sparkSession, path)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row starts, with a last entry for the end. Null: empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish for 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of all rows start and end in raw, and the row of each. Words never cross rows."""
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    edge = edge[: len(raw)]
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (edge | ~before))
    after = np.empty(len(raw), bool)
    if len(raw):
        after[-1] = True
        after[:-1] = ~inside[1:] | edge[1:]
    end = np.flatnonzero(inside & after) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes than this are hashed one by one.
_LONG = 64


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, A-Z lowered, zeros beyond the end."""
    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[: len(raw)] = _LOWER[raw]
    return np.ndarray(len(raw) + 8, "<u8", padded.data, strides=(1,))


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, eights: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lowered: no two words below eight bytes share one.

    Eight bytes at a time go through a bijective finish, so that no sum of differences makes hashes meet.
    """
    eights = _eights(raw) if eights is None else eights
    size = end - begin
    h = mixed((eights[begin] & _MASK[np.minimum(size, 8)]) ^ (np.minimum(size, 255).astype(np.uint64) << np.uint64(56)))
    at = 8
    rest = np.flatnonzero(size > 7)
    while len(rest) and at < _LONG:
        h[rest] = mixed(h[rest] * np.uint64(0x9E3779B97F4A7C15) + (eights[begin[rest] + at] & _MASK[np.clip(size[rest] - at, 0, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(_LOWER[raw[begin[i] : end[i]]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_kinds(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each kind of word, a word of each kind, the kind of each word), A-Z lowered.

    Words are sorted out by hash and then held against their kind's word byte by byte, so that words that share a hash are
    kinds of their own all the same.
    """
    eights = _eights(raw)
    h = word_hashes(raw, begin, end, eights)
    kinds = np.unique(h)
    back = np.searchsorted(kinds, h)
    one = np.zeros(len(kinds), np.int64)
    one[back[::-1]] = np.arange(len(h))[::-1]
    if same_words(raw, eights, begin, end, begin[one][back], end[one][back]).all():
        return kinds, one, back
    seen: dict[bytes, int] = {}
    data = _LOWER[raw].tobytes()
    back = np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
    one = np.zeros(len(seen), np.int64)
    one[back[::-1]] = np.arange(len(h))[::-1]
    return h[one], one, back


def same_words(raw: np.ndarray, eights: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether stretches a and b have equal bytes, A-Z lowered."""
    size = a_end - a
    same = size == b_end - b
    at, rest = 0, np.flatnonzero(same & (size > 0))
    while len(rest) and at < _LONG:
        mask = _MASK[np.clip(size[rest] - at, 0, 8)]
        differ = (eights[a[rest] + at] ^ eights[b[rest] + at]) & mask != 0
        same[rest[differ]] = False
        at += 8
        rest = rest[(size[rest] > at) & ~differ]
    for i in rest:
        same[i] = bool(np.array_equal(_LOWER[raw[a[i] : a_end[i]]], _LOWER[raw[b[i] : b_end[i]]]))
    return same


def word_bytes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Words as a binary column, A-Z lowered."""
    size = end - begin
    ends = np.concatenate([[0], np.cumsum(size)])
    pick = np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(_LOWER[raw[pick]])])


class Table:
    """Where 64-bit keys stand in a list of different ones: open addressing over two to four slots a key, all keys at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = (1 << max(10, (2 * len(keys)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.mask.bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        if len(keys) > 1 << 17:  # little room at once
            for i in range(0, len(keys), 1 << 17):
                out[i : i + (1 << 17)] = self.find(keys[i : i + (1 << 17)])
            return out
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == keys[todo])
            out[todo[hit]] = got[hit]
            go = (got >= 0) & ~hit
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge: the least node that it reaches.

    In each round a node goes over to its neighbour of least rank, if that is below its own, and edges go with it; equal ones and those within
    a node fall away. Ranks are drawn anew for each round, so about half of the nodes go, and a chain in any order takes as many rounds as its
    length has binary digits. Each round is a written table, so its lineage stays short and an executor's loss costs one round.
    """
    ordered = lambda df, x, y: df.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).where("u != v").distinct()
    live = written(ordered(edges, F.col(a), F.col(b)))
    labels, turn = None, 0
    while not live.isEmpty():
        rank = lambda c, turn=turn: F.xxhash64(F.lit(turn), c)
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("near"))
        moves = written(near.select(F.col("u").alias("node"), F.when(rank("near") < rank("u"), F.col("near")).otherwise(F.col("u")).alias("to")))
        if labels is None:
            fresh = written(moves.select("node", F.col("to").alias("label")))
        else:
            fresh = written(labels.join(moves.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
            dropped(labels)
        side = lambda c: moves.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
        after = written(ordered(live.join(side("u"), "u").join(side("v"), "v"), F.col("to_u"), F.col("to_v")))
        dropped(live, moves)
        live, labels, turn = after, fresh, turn + 1
    if labels is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    out = written(labels.join(least, "label").select("node", "component"))
    dropped(labels, live)
    return out


def fold(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def slices(batches, text: int | str, limit: int = 1 << 19):
    """The batches, cut so that a piece holds at most limit bytes of text, or one row."""
    for batch in batches:
        column = batch.column(text)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not len(column):
            continue
        _, starts = string_bytes(column)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def by_count(df: DataFrame, count: str, most: int) -> int:
    """The least count such that at most `most` rows have that many or more: a proven bound for what is then broadcast.

    Counts are binned by sixteenths of a doubling, so only some hundreds of sums reach the driver.
    """
    bins = df.groupBy(F.floor(F.log2(F.col(count)) * 16).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(count).alias("low")).collect()
    kept, low = 0, None
    for row in sorted(bins, key=lambda r: -r["bin"]):
        kept += row["n"]
        if kept > most:
            break
        low = row["low"]
    return low if low is not None else 1 << 62
