"""Language-model scores by prediction by partial matching (PPM) over a byte-context trie.

The model sees a whole text as a start symbol, its bytes with A-Z lowered, and an end symbol. A symbol's contexts are the up to
`order` symbols before it, whatever words they belong to. Counts come from all training documents. The longest
context predicts; a symbol that it hasn't seen costs an escape (method C: as likely as the context has different
symbols, among its count and those), and the next shorter context then predicts among the symbols not yet excluded. Below
the shortest, the symbols left are equally likely. So a text's score is the logarithm of a proper probability.

Scale: what decides on a symbol is the string of its longest context and itself, its top. Tops are counted in one pass, shorter strings are
sums over them, and the model is scored once for each different top: the trie is a table of these strings, and tops are scored by joins with it. What is
left after an escape depends on the context alone, so it is worked out once for each. Broadcast are, each with a bound: the MOST_TOPS most
frequent tops with their scores (34 MB) and the MOST_WORDS most frequent words with their counts (10 MB). A document's other tops and
words are looked up by joins.

Cases: a null or empty text is just its end symbol; with no training documents every count is 0 and the model is even over its
symbols; a null key counts as a training document, as its checksum is null; repeated rows are scored each; very long texts
are scored by pieces of rows, one text at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import _LOWER, Table, by_count, dropped, fold, slices, small_batches, string_bytes, word_bytes, word_hashes, word_kinds, words, written

ORDER, SYMBOLS = 5, 256
MOST_WORDS, MOST_TOPS = 1 << 18, 1 << 20
#: Rows of counted strings that a task gathers before equal ones are added up.
GATHERED = 1 << 20
#: Bytes that no UTF-8 text has.
START, STOP = 0xFE, 0xFF
#: The end stands among the words as what can't be one.
END = b"\n"


def _symbols(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """START, bytes and STOP of each row, flat; each symbol's row; its place in the row."""
    size = np.diff(starts) + 2
    ends = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(ends[-1]) - ends[owner]
    out = np.full(ends[-1], START, np.uint8)
    out[ends[1:] - 1] = STOP
    inside = np.ones(len(out), bool)
    inside[ends[:-1]] = inside[ends[1:] - 1] = False
    out[inside] = _LOWER[raw]
    return out, owner, place


def _tops(raw: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(top, row) of each symbol but START: the string of its longest context and itself as a number, with its length on top."""
    out, owner, place = _symbols(raw, starts)
    depth = np.minimum(place, order)
    value = np.zeros(len(out), np.uint64)
    for k in range(min(order, len(out)) + 1):
        shifted = out[: len(out) - k].astype(np.uint64) << np.uint64(8 * k)
        value[k:] |= np.where(depth[k:] >= k, shifted, np.uint64(0))
    value |= (depth + 1).astype(np.uint64) << np.uint64(56)
    use = place > 0
    return value[use], owner[use]


def _count_words(batches):
    """(text, training) to (word, count in training documents), for the words of a piece."""
    for piece in slices(batches, 0, 1 << 20):
        raw, starts = string_bytes(piece.column(0))
        begin, end, row = words(raw, starts)
        _, one, back = word_kinds(raw, begin, end)
        train = piece.column(1).to_numpy(zero_copy_only=False).astype(float)
        n = np.bincount(back, weights=train[row], minlength=len(one)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([word_bytes(raw, begin[one], end[one]), pa.array(n)], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([int(train.sum())], pa.int64())], names=["word", "n"])


def _added_up(tops: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each top once, with the sum of its counts; the parts are sorted, so a stable sort only merges them."""
    top, n = np.concatenate(tops), np.concatenate(n)
    order = np.argsort(top, kind="stable")
    top = top[order]
    first = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    return top[first], np.add.reduceat(n[order], first)


def _count_tops(order: int):
    """(text, training) to (top, count in training documents); a task's equal tops are added up as long as GATHERED rows hold them."""

    def run(batches):
        out = lambda top, n: pa.RecordBatch.from_arrays([pa.array(top.view(np.int64)), pa.array(n)], names=["top", "n"])
        tops, counts, rows = [], [], 0
        for piece in slices(batches, 0):
            train = piece.column(1)
            for part, times in ((piece.filter(train), 1), (piece.filter(pa.compute.invert(train)), 0)):
                if part.num_rows:
                    raw, starts = string_bytes(part.column(0))
                    top, n = np.unique(_tops(raw, starts, order)[0], return_counts=True)
                    tops.append(top)
                    counts.append(n * times)
                    rows += len(top)
            if rows > GATHERED:
                top, n = _added_up(tops, counts)
                tops, counts, rows = [top], [n], len(top)
                if rows > GATHERED // 2:
                    yield out(top, n)
                    tops, counts, rows = [], [], 0
        if tops:
            yield out(*_added_up(tops, counts))

    return run


def _suffixes(order: int):
    """Counted tops to counted context-symbol strings of every order: a top's end stands for its shorter contexts."""

    def run(batches):
        for batch in batches:
            tops, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(float)
            length = (tops >> np.uint64(56)).astype(np.int64)
            for k in range(1, order + 2):
                use = length >= k
                kinds, back = np.unique(tops[use] & np.uint64((1 << 8 * k) - 1), return_inverse=True)
                if len(kinds):
                    yield pa.RecordBatch.from_arrays([pa.array((kinds | np.uint64(k << 56)).view(np.int64)), pa.array(np.bincount(back, weights=n[use]).astype(np.int64))], names=["gram", "n"])

    return run


def _joined(tops: DataFrame, grams: DataFrame) -> DataFrame:
    """(top, n, log10 probability of the top's last symbol after the others), by joins with the table of all strings."""
    size = lambda c: F.shiftrightunsigned(c, 56)
    headed = lambda body, n: f"({body}) | shiftleft({n}, 56)"
    # a context has its string's length on top, so that it has one byte fewer than that says
    context = lambda c: F.expr(headed(f"shiftright({c} & {(1 << 56) - 1}, 8)", f"shiftrightunsigned({c}, 56)"))
    low = lambda c, n: F.expr(headed(f"{c} & (shiftleft(1L, cast(8 * ({n}) as int)) - 1)", "shiftrightunsigned(" + c + ", 56) - 1L"))
    own = grams.select("gram", "n", context("gram").alias("context"))
    sums = own.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    lower = own.where(size("gram") > 1).select("context", low("gram", "shiftrightunsigned(gram, 56) - 1").alias("gram")).join(grams, "gram")
    gone = lower.groupBy("context").agg(F.sum("n").alias("gone"))
    up = sums.select(F.col("context").alias("parent"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
    below = sums.where(size("context") > 1).join(gone, "context").withColumn("parent", low("context", "shiftrightunsigned(context, 56) - 2")).join(up, "parent")
    left = below.select("context", (F.col("up_total") - F.col("gone")).alias("left_total"), (F.col("up_kinds") - F.col("kinds")).alias("left_kinds"))
    contexts = written(sums.join(left, "context", "left"))
    root = contexts.where(F.col("context") == 1 << 56).first()
    levels = tops.select("top").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), size("top"))))
    levels = levels.withColumn("gram", F.expr(headed("top & (CASE WHEN k < 7 THEN shiftleft(1L, cast(8 * k as int)) - 1 ELSE 72057594037927935L END)", "k"))).withColumn("context", context("gram"))
    met = levels.join(contexts, "context", "left").join(grams, "gram", "left")
    after, whole = Window.partitionBy("top").orderBy(F.desc("k")), Window.partitionBy("top")
    # after an escape, what the longer context leaves
    met = met.select("top", "k", "n", F.coalesce(F.lag("left_total").over(after), "total").alias("total"), F.coalesce(F.lag("left_kinds").over(after), "kinds").alias("kinds"), F.max(F.when(F.col("n").isNotNull(), F.col("k"))).over(whole).alias("hit"))
    share = F.when(F.col("kinds") > 0, F.log10(F.when(F.col("k") == F.col("hit"), F.col("n")).otherwise(F.col("kinds")) / (F.col("total") + F.col("kinds")))).otherwise(0.0)
    logs = met.groupBy("top").agg((F.sum(F.when(F.col("hit").isNull() | (F.col("k") >= F.col("hit")), share)) - F.when(F.max("hit").isNull(), float(np.log10(max(SYMBOLS - (root["kinds"] if root else 0), 1)))).otherwise(0.0)).alias("log"))
    return tops.join(logs, "top").select("top", "n", "log")


class Words:
    """Frequent words with what counts for each, looked up by hash and then by bytes."""

    def __init__(self, found: list[bytes], base: np.ndarray):
        size = np.array([len(w) for w in found], np.int64)
        self.raw = np.frombuffer(b"".join(found), np.uint8)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        hashes = word_hashes(self.raw, self.begin, self.end)
        # of words that share a hash one is here, the others are looked up by the join
        kinds, one = np.unique(hashes, return_index=True)
        self.begin, self.end, self.base = self.begin[one], self.end[one], base[one]
        self.table = Table(kinds)

    def find(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, -1 where it isn't here."""
        at = self.table.find(hashes)
        own, other = word_bytes(raw, begin, end), word_bytes(self.raw, self.begin, self.end) if len(self.begin) else None
        met = np.flatnonzero(at >= 0)
        if len(met):
            equal = pa.compute.equal(own.take(pa.array(met)), other.take(pa.array(at[met]))).to_numpy(zero_copy_only=False)
            at[met[~equal]] = -1
        return at


def _lists(row: np.ndarray, kind: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(offsets by row, kinds in that order, how often each) of pairs, for list columns."""
    pairs, times = np.unique(row.astype(np.int64) << 32 | kind, return_counts=True)
    ends = pa.array(np.searchsorted(pairs >> 32, np.arange(n + 1)).astype(np.int32))
    return ends, pairs & 0xFFFFFFFF, pa.array(times.astype(np.int32))


def _summed(head, order: int):
    """Documents to the sums over their frequent words and tops, and the other words and tops with how often each."""
    names = ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times", "tops", "top_times"]

    def run(batches):
        frequent, table, logs = head.value
        for piece in slices(batches, 2):
            n = len(piece.column(0))
            raw, starts = string_bytes(piece.column(2))
            begin, end, row = words(raw, starts)
            hashes, one, back = word_kinds(raw, begin, end)
            where = frequent.find(raw, begin[one], end[one], hashes)[back]
            often = where >= 0
            base = np.bincount(row[often], weights=frequent.base[where[often]], minlength=n)
            ends, rare, times = _lists(row[~often], back[~often], n)
            tops, owner = _tops(raw, starts, order)
            at = table.find(tops)
            found = at >= 0
            score = np.bincount(owner[found], weights=logs[at[found]], minlength=n)
            kinds, kind = np.unique(tops[~found], return_inverse=True)
            top_ends, top, top_times = _lists(owner[~found], kind, n)
            lists = [pa.ListArray.from_arrays(ends, word_bytes(raw, begin[one][rare], end[one][rare])), pa.ListArray.from_arrays(ends, times), pa.ListArray.from_arrays(top_ends, pa.array(kinds[top].view(np.int64))), pa.ListArray.from_arrays(top_ends, top_times)]
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), piece.column(1), pa.array(np.bincount(row, minlength=n) + 1), pa.array(np.bincount(row[often], minlength=n)), pa.array(base.astype(float)), pa.array(score.astype(float)), *lists], names=names)

    return run


def ppm_scores(docs: DataFrame, held_out, text: str = "text", key: str = "doc_id", order: int = ORDER, most_words: int = MOST_WORDS, most_tops: int = MOST_TOPS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score).

    held_out: a boolean column; the model and the word counts come from the rows where it isn't true.
    """
    if order > 6:
        raise ValueError("a context has at most 6 symbols")
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    learnt = docs.select("text", ~F.col("held_out"))
    vocabulary = written(learnt.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tops = written(learnt.mapInArrow(_count_tops(order), "top long, n long").groupBy("top").agg(F.sum("n").alias("n")))
    facts = vocabulary.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds")).first()
    tokens, kinds = facts["tokens"], facts["kinds"]
    grams = written(tops.where("n > 0").mapInArrow(_suffixes(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    scored = written(_joined(tops, grams))
    dropped(tops, grams)
    base = F.log10((F.col("n") + F.lit(0.1)) / F.lit(tokens + 0.1 * (kinds + 1)))
    least = by_count(vocabulary.where("n > 0"), "n", most_words)
    often = vocabulary.where((F.col("n") >= least) & (F.col("word") != END)).select("word", base.alias("base")).toArrow()
    least_top = by_count(scored.where("n > 0"), "n", most_tops)
    head_tops = scored.where(F.col("n") >= least_top).select("top", "log").toArrow()
    head = context.broadcast((Words(often.column("word").to_pylist(), often.column("base").to_numpy()), Table(head_tops.column("top").to_numpy().view(np.uint64)), head_tops.column("log").to_numpy()))
    end = vocabulary.where(F.col("word") == END).select(base.alias("base"), (F.col("n") > 0).cast("long").alias("known")).first()
    end_base, end_known = (end["base"], end["known"]) if end else (0.0, 0)
    sums = docs.select("doc_id", "held_out", "text").mapInArrow(_summed(head, order), "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<binary>, times array<int>, tops array<long>, top_times array<int>")
    sums = written(sums.withColumn("row", F.monotonically_increasing_id()))
    each = lambda a, b: sums.select("row", F.explode(F.arrays_zip(a, b)).alias("w"))
    rare = each("rare", "times").select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    more = rare.join(vocabulary, "word").groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * base).alias("more_base"))
    rare_tops = each("tops", "top_times").select("row", F.col("w.tops").alias("top"), F.col("w.top_times").alias("times"))
    more_tops = rare_tops.join(scored, "top").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return sums.drop("rare", "times", "tops", "top_times").join(more, "row", "left").join(more_tops, "row", "left").select(
        F.col("doc_id").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + zero("more_known") + F.lit(end_known)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base") + F.lit(end_base)).alias("base_score"),
        (F.col("score") + zero("more_score")).alias("score"),
    )


def op10_ppm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ppm_scores(docs, fold("doc_id", 10) == 0)
