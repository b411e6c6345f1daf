"""Near-duplicate documents by an n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles, as 64-bit hashes. All sets follow one order, shingles that look
rare first; "looks rare" comes from a fixed-size count sketch over all documents, and any order gives the same links.
Two documents that reach the similarity share l shingles within their l-prefixes (n - ceil(t n) + l shingles each), for
every l. Each document's l follows its estimated candidate cost, the sketched lengths of its prefix's lists: a costly
document gets a longer prefix and asks for as many shared tokens before it is verified; a pair asks for the lesser l.

Candidates come in two rounds. First every list is compared with its most costly document only, which joins a group of
copies along a star. Components found so far are then contracted, and only pairs of different components are compared,
so copies that are already connected never meet pair by pair. Pairs that can't reach the similarity are dropped as they meet, by
how far along both sets the shared token stands and by parity signatures of the whole sets. Equal sets are one document
throughout. Verification is exact on the whole sets.

A token's list with more than LANE documents that are still apart is dealt out in lanes, and each pair of lanes meets in a task of its own.

Cases: null text, or one without words, has an empty set and is linked with nothing; a null key takes no part and has a
null component; rows with one key are one document's parts and share its component; very long texts are one piece each, at some 60
bytes of room a word; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import components, dropped, mixed, slices, small_batches, string_bytes, word_hashes, words, written

SKETCH_BITS, SKETCH_BLOCKS = 18, 64
#: Documents of a list that meet in one task.
LANE = 1024
#: Bits of a set's parity signature.
PARITY = 1024
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each row, by row and hash; fewer words: the whole sequence as one."""
    raw, starts = string_bytes(column)
    begin, end, row = words(raw, starts)
    h = word_hashes(raw, begin, end)
    n = len(h)
    count = np.bincount(row, minlength=len(column)) if n else np.zeros(len(column), np.int64)
    out_row, out_hash = [], []
    if n >= k:
        whole = row[: n - k + 1] == row[k - 1 :]
        sums = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            sums += h[j : n - k + 1 + j] * _ODD[j]
        out_row.append(row[: n - k + 1][whole])
        out_hash.append(sums[whole])
    first = np.cumsum(count) - count
    for c in range(1, k):
        short = np.flatnonzero(count == c)
        if len(short):
            sums = np.full(len(short), np.uint64(c))
            for j in range(c):
                sums += h[first[short] + j] * _ODD[j]
            out_row.append(short)
            out_hash.append(sums)
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r, s = np.concatenate(out_row), mixed(np.concatenate(out_hash))
    order = np.lexsort((s, r))
    r, s = r[order], s[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    return r[fresh], s[fresh]


def _sketch_of(k: int):
    def run(batches):
        seen = np.zeros(1 << SKETCH_BITS, np.int64)
        for piece in slices(batches, 0):
            _, h = shingles(piece.column(0), k)
            seen += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(seen))
        blocks = seen.reshape(SKETCH_BLOCKS, -1)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=["block", "counts"])

    return run


def _summed(batches):
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(cell.as_buffer(), np.int64)
            seen[block] = seen[block] + part if block in seen else part.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([x.tobytes() for x in seen.values()], pa.binary())], names=["block", "counts"])


def count_sketch(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """How many documents' shingles fall into each of 2**SKETCH_BITS slots: 2 MB a task, in blocks that are each added up by one of SKETCH_BLOCKS tasks."""
    schema = "block int, counts binary"
    parts = docs.select(text).mapInArrow(_sketch_of(k), schema)
    # each row is a block of a whole task
    gathered = parts.repartition(SKETCH_BLOCKS, "block").mapInArrow(_summed, schema).collect()
    out = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.int64)
    for row in gathered:
        out[row["block"]] += np.frombuffer(row["counts"], np.int64)
    return out.ravel()


def _parity(h: np.ndarray, first: np.ndarray, some: np.ndarray) -> np.ndarray:
    """A row's signature: each shingle turns one bit over, so two signatures differ in no more bits than the sets differ in shingles."""
    out = np.zeros((len(first), PARITY // 64), np.uint64)
    if len(h):
        bit = (h >> np.uint64(8)) % np.uint64(PARITY)
        word, value = (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))
        for j in range(out.shape[1]):
            out[some, j] = np.bitwise_xor.reduceat(np.where(word == j, value, np.uint64(0)), first[some])
    return out.ravel().view(np.int64)


def _prefixes(k: int, percent: int, sketch):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("ell", pa.int32()), ("cost", pa.int64()), ("parity", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        seen = sketch.value
        mean = int(seen.sum() >> SKETCH_BITS)
        for piece in slices(batches, 1):
            keys, column = piece.column(0), piece.column(1)
            r, h = shingles(column, k)
            n = np.bincount(r, minlength=len(column)) if len(r) else np.zeros(len(column), np.int64)
            first = np.cumsum(n) - n
            zero, some = np.zeros(len(column), np.uint64), n > 0
            d1, d2 = zero.copy(), zero.copy()
            if len(r):
                d1[some] = np.add.reduceat(mixed(h ^ _ODD[1]), first[some])
                d2[some] = np.add.reduceat(mixed(h ^ _ODD[2]), first[some])
            parity = _parity(h, first, some)
            lists = np.maximum(seen[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] - mean, 1)
            order = np.lexsort((h, lists, r))
            h, lists = h[order], lists[order]
            need = (percent * n + 99) // 100  # of its own shingles, each partner shares as many at least
            plain = np.where(some, n - need + 1, 0)
            upto = np.concatenate([[0], np.cumsum(lists)])
            cost = upto[first + plain] - upto[first]
            ell = 1 + np.floor(np.log2(1 + cost / np.maximum(plain, 1))).astype(np.int64)
            ell = np.maximum(1, np.minimum(np.minimum(ell, 8), need))
            size = np.where(some, n - need + ell, 0)
            ends = np.concatenate([[0], np.cumsum(size)])
            pick = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [keys.cast(pa.int64()), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(ell.astype(np.int32)), pa.array(cost), pa.ListArray.from_arrays(pa.array((np.arange(len(column) + 1) * (PARITY // 64)).astype(np.int32)), pa.array(parity)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[pick].view(np.int64)))],
                schema=schema,
            )

    return run


def _sets(k: int):
    def run(batches):
        for piece in slices(batches, 1):
            r, h = shingles(piece.column(1), k)
            ends = np.searchsorted(r, np.arange(len(piece.column(0)) + 1))
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), piece.column(2), piece.column(3), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))], names=["doc", "is_a", "is_b", "grams"])

    return run


def _linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets reach the similarity; written.

    Sets are made for the documents of pairs alone, told apart by their side, so that a star's set is sent as an a only.
    """
    ids = pairs.select(F.col("a").alias("doc_id"), F.lit(True).alias("is_a"), F.lit(False).alias("is_b")).unionByName(pairs.select(F.col("b").alias("doc_id"), F.lit(False).alias("is_a"), F.lit(True).alias("is_b")))
    ids = ids.groupBy("doc_id").agg(F.max("is_a").alias("is_a"), F.max("is_b").alias("is_b"))
    # dealt by key at every size: a side's size decides nothing here
    sets = written(docs.join(ids.hint("merge"), "doc_id").select("doc_id", "text", "is_a", "is_b").mapInArrow(_sets(k), "doc long, is_a boolean, is_b boolean, grams array<long>"))
    left, right = sets.where("is_a").select(F.col("doc").alias("a"), F.col("grams").alias("ga")), sets.where("is_b").select(F.col("doc").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    out = written(pairs.join(right, "b").join(left, "a").where(100 * both >= percent * (F.size("ga") + F.size("gb") - both)).select("a", "b"))
    dropped(sets)
    return out


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 4, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id): each document's set size and the least key that it reaches by links."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = spark.sparkContext.broadcast(count_sketch(docs, "text", k))
    wide = written(docs.mapInArrow(_prefixes(k, percent, sketch), "doc_id long, n long, d1 long, d2 long, ell int, cost long, parity array<long>, prefix array<long>"))
    told = wide.where("n > 0 AND doc_id IS NOT NULL")
    every = written(wide.select("doc_id", "n", "d1", "d2"))
    first = written(told.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "ell", "cost", "parity", "prefix")).alias("m")).select("d1", "d2", "n", F.col("m.doc_id").alias("doc"), "m.ell", "m.cost", "m.parity", "m.prefix"))
    dropped(wide)
    reps = written(first.drop("prefix", "cost"))
    # set size and place in one number
    index = first.select(F.posexplode("prefix").alias("place", "token"), "doc", "n", F.col("cost").cast("float").alias("cost")).select("token", "doc", "cost", (F.shiftleft("n", 24) + F.col("place")).alias("at"))
    lists = index.groupBy("token").agg(F.count("*").alias("length"), F.max_by("doc", "cost").alias("star")).where("length > 1").select("token", "star")
    shared = written(index.join(lists, "token").select("token", "doc", "star", F.shiftright("at", 24).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 24) - 1)).alias("place")))
    dropped(first)
    # how many of the document's shingles before this one are in other lists too: no more can be shared there
    before = Window.partitionBy("doc").orderBy("place", "token")
    shared_ = written(shared.withColumn("before", F.row_number().over(before) - 1))
    dropped(shared)
    shared = shared_
    facts = reps.select("doc", "ell", "parity")
    side = lambda name: [F.col(c).alias(f"{c}_{name}") for c in ("doc", "n", "place", "before")]

    def can_link(shared_before, x: str = "a", y: str = "b"):
        """Whether a pair with one more token shared at these places can reach the similarity, if all that follows is shared."""
        most = shared_before + 1 + F.least(F.col(f"n_{x}") - F.col(f"place_{x}"), F.col(f"n_{y}") - F.col(f"place_{y}")) - 1
        sizes = F.col(f"n_{x}") + F.col(f"n_{y}")
        return ((100 + percent) * most >= percent * sizes) & (100 * F.least(f"n_{x}", f"n_{y}") >= percent * F.greatest(f"n_{x}", f"n_{y}"))

    def few_differences(n_a: str, n_b: str, x: str, y: str):
        """Whether two signatures differ in so few bits that the sets can reach the similarity."""
        differ = sum((F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))) for i in range(1, PARITY // 64)), F.bit_count(F.get(x, 0).bitwiseXOR(F.get(y, 0))))
        sizes = F.col(n_a) + F.col(n_b)
        return (100 + percent) * (sizes - differ) >= 2 * percent * sizes

    def candidates(met: DataFrame, all_lists: bool) -> DataFrame:
        """(a, b) of pairs that met in lists, if they share as many tokens as they need and, where they met in all lists that they share, what follows the last can make up the rest."""
        pairs = met.groupBy(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).agg(F.count("*").alias("tokens"), F.max("place_a").alias("place_a"), F.max("place_b").alias("place_b"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
        pairs = pairs.where(can_link(F.col("tokens") - 1)) if all_lists else pairs
        ells = [facts.select(F.col("doc").alias(c), F.col("ell").alias(f"ell_{c}"), F.col("parity").alias(f"parity_{c}")) for c in ("a", "b")]
        able = (F.col("tokens") >= F.least("ell_a", "ell_b")) & few_differences("n_a", "n_b", "parity_a", "parity_b")
        return pairs.join(ells[0], "a").join(ells[1], "b").where(able).select("a", "b")

    at_star = shared.where("doc = star").select("token", *side("a"))
    met = shared.where("doc != star").select("token", *side("b")).join(at_star, "token").where(can_link(F.least("before_a", "before_b")))
    stars = written(candidates(met, all_lists=False))
    links = _linked(stars, docs, k, percent)
    near = components(links, "a", "b")
    placed = written(shared.join(near.withColumnRenamed("node", "doc"), "doc", "left").select("token", "doc", "n", "place", "before", F.coalesce("component", "doc").alias("part")))
    mixed_lists = written(placed.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("n").alias("least")).where("low != high").select("token", "least"))
    # who can't reach even the smallest of a list needn't stay in it
    rest = placed.join(mixed_lists, "token").where((100 + percent) * (F.col("n") - F.col("place") + F.col("before")) >= percent * (F.col("n") + F.greatest("least", F.ceil(F.col("n") * percent / 100))))
    rest = written(rest.select("token", "part", "doc", "n", "place", "before"))
    lanes = rest.groupBy("token").agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes"))
    lane = F.pmod(F.xxhash64("doc"), F.col("lanes")).cast("int")
    placed_lanes = rest.join(lanes, "token").withColumn("lane", lane).join(facts, "doc")
    # a list of several lanes meets by pairs of them, each pair in a task of its own
    others = lambda a, b: F.explode(F.transform(F.sequence(F.lit(0), F.col("lanes") - 1), lambda i: F.struct(a(i).alias("la"), b(i).alias("lb")))).alias("l")
    own = F.col("lane")
    sided = lambda name, pick: placed_lanes.select("token", F.col("part").alias(f"part_{name}"), F.col("parity").alias(f"parity_{name}"), *side(name), pick).select("*", "l.la", "l.lb").drop("l")
    x, y = sided("a", others(lambda i: own, lambda i: i)), sided("b", others(lambda i: i, lambda i: own))
    able = (F.col("part_a") < F.col("part_b")) & can_link(F.least("before_a", "before_b")) & few_differences("n_a", "n_b", "parity_a", "parity_b")
    cross = candidates(x.join(y, ["token", "la", "lb"]).where(able), all_lists=True)
    tried = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = _linked(written(cross.join(tried, ["a", "b"], "left_anti")), docs, k, percent)
    final = components(links.unionByName(more), "a", "b")
    dropped(shared, stars, placed, mixed_lists, rest, near, links, more)
    found = reps.select("d1", "d2", "n", F.col("doc").alias("node")).join(final, "node", "left").select("d1", "d2", "n", F.coalesce("component", "node").alias("component"))
    out = every.alias("e").join(found.alias("f"), (F.col("e.d1") == F.col("f.d1")) & (F.col("e.d2") == F.col("f.d2")) & (F.col("e.n") == F.col("f.n")), "left")
    alone = F.col("e.doc_id").isNull() | (F.col("e.n") == 0)
    return out.select(F.col("e.doc_id").alias(key), F.col("e.n").alias("n_shingles"), F.when(alone, F.col("e.doc_id")).otherwise(F.col("component")).alias("component_id"))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
