"""Language identification as inference of a mixture.

A language is a distribution over hashed byte trigrams of lower-cased words with their surrounding spaces, counted over all
training documents. A word's likelihood under a language is its trigrams' product, tempered. A document's words come
from a mixture of languages, whose proportions expectation-maximisation estimates. Which languages are in the mixture at all
is chosen by penalised likelihood: sets of the largest proportions are held against each other, each language beyond
the first costing half the logarithm of the number of words (BIC); sets grow until none beyond can win. A document is given its
mixture's largest language, and the proportion is the score; the whole mixture is given beside it.

All words of a task's piece go through the steps together, as matrices of words by languages.

Cases: a null text, or one without a letter, is `und` with score 0, as is every text if nothing was learned; rows with a null
language teach nothing; of languages that tie the first by name is given; repeated rows count each; a very long text is one piece; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import _LOWER, fold, mixed, slices, small_batches, string_bytes, word_kinds, words

BUCKETS, MOST_LANGUAGES = 1 << 15, 256
TEMPER = 0.7
#: Steps of expectation-maximisation end when no proportion moves by more than this, or after so many.
STILL, MOST_STEPS = 1e-3, 100
#: What the likelihood may still gain when they end, at most.
SLACK = 0.1


def _trigrams(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the trigrams of each word with a space on either side."""
    size = end - begin
    total = size + 2
    ends = np.concatenate([[0], np.cumsum(total)])
    out = np.full(ends[-1] + 2, 0x20, np.uint64)
    owner = np.repeat(np.arange(len(size)), total)
    place = np.arange(ends[-1]) - ends[owner]
    inside = np.flatnonzero((place > 0) & (place <= size[owner]))
    out[inside] = _LOWER[raw[(begin - ends[:-1] - 1)[owner[inside]] + inside]]
    use = place < size[owner]  # the trigram that starts here ends within the word and its spaces
    value = out[:-2] | out[1:-1] << np.uint64(8) | out[2:] << np.uint64(16)
    return (mixed(value[use]) % np.uint64(BUCKETS)).astype(np.int64), owner[use]


def _learned(batches):
    """(text, lang) to counts by (lang, bucket), one row for each that a task has."""
    counts: dict[str, np.ndarray] = {}
    for piece in slices(batches, 0):
        labels = piece.column(1).to_pylist()
        raw, starts = string_bytes(piece.column(0))
        begin, end, row = words(raw, starts)
        _, first, back = word_kinds(raw, begin, end)
        bucket, kind = _trigrams(raw, begin[first], end[first])
        names = sorted(set(labels))
        code = np.array([names.index(x) for x in labels])
        for i, name in enumerate(names):
            times = np.bincount(back[code[row] == i], minlength=len(first)).astype(float)
            counts.setdefault(name, np.zeros(BUCKETS))
            counts[name] += np.bincount(bucket, weights=times[kind], minlength=BUCKETS)
    for name, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])


class Model:
    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        share = (counts + 0.05) / (counts.sum(axis=0) + 0.05 * len(counts)) if len(names) else counts
        self.logs = np.log(share)  # buckets by languages

    def word_logs(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tempered log likelihood of each word under each language."""
        bucket, word = _trigrams(raw, begin, end)
        out = np.empty((len(begin), len(self.names)))
        for i in range(len(self.names)):
            out[:, i] = np.bincount(word, weights=self.logs[bucket, i], minlength=len(begin))
        return out * TEMPER

    def mixtures(self, logs: np.ndarray, row: np.ndarray, n: int, times: np.ndarray | None = None) -> np.ndarray:
        """Proportions of the languages in each of n documents, whose words (each so many times) have these log likelihoods."""
        k = logs.shape[1]
        times = np.ones(len(row)) if times is None else times.astype(float)
        count = np.bincount(row, weights=times, minlength=n)
        like = np.exp(logs - logs.max(axis=1, keepdims=True))
        full, bound = self._em(like, row, times, np.ones((n, k), bool))
        bound += SLACK  # no set's likelihood is above that of all languages
        ranked = np.argsort(-full, axis=1, kind="stable")
        best, share = np.full(n, -np.inf), np.zeros((n, k))
        open_ = np.arange(n)
        for size in range(1, k + 1):
            chosen = np.zeros((len(open_), k), bool)
            np.put_along_axis(chosen, ranked[open_, :size], True, axis=1)
            place = np.full(n, -1)
            place[open_] = np.arange(len(open_))
            use = np.flatnonzero(place[row] >= 0)
            got, value = self._em(like[use], place[row[use]], times[use], chosen)
            cost = 0.5 * np.log(np.maximum(count[open_], 2))
            value = value - (size - 1) * cost
            better = value > best[open_]
            share[open_[better]], best[open_[better]] = got[better], value[better]
            # a larger set costs more than it could gain
            open_ = open_[bound[open_] - size * cost > best[open_]]
            if not len(open_):
                break
        return share

    @staticmethod
    def _em(like, row, times, chosen):
        """(proportions, log likelihood) from even proportions of the chosen languages; rows of words are sorted or not."""
        n, k = chosen.shape
        share = chosen / chosen.sum(axis=1, keepdims=True)
        count = np.maximum(np.bincount(row, weights=times, minlength=n), 1)[:, None]
        single = chosen.sum(axis=1) == 1
        active, words = np.flatnonzero(~single), np.flatnonzero(~single[row])
        for _ in range(MOST_STEPS):
            if not len(active):
                break
            place = np.full(n, -1)
            place[active] = np.arange(len(active))
            own = row[words]
            joint = like[words] * share[own]
            joint *= (times[words] / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
            fresh = np.stack([np.bincount(place[own], weights=joint[:, i], minlength=len(active)) for i in range(k)], axis=1) / count[active]
            moved = np.abs(fresh - share[active]).max(axis=1) > STILL
            share[active] = fresh
            active = active[moved]
            still = np.zeros(n, bool)
            still[active] = True
            words = words[still[own]]
        value = np.bincount(row, weights=times * np.log(np.maximum((like * share[row]).sum(axis=1), 1e-300)), minlength=n)
        return share, value


def _predicted(model):
    names = ["doc_id", "held_out", "lang_pred", "score", "mixture"]

    def run(batches):
        own = model.value
        for piece in slices(batches, 2):
            column = piece.column(2)
            n = len(column)
            letter = np.array([bool(t) and any(map(str.isalpha, t)) for t in column.to_pylist()])
            label, score, mixture = np.full(n, "und", object), np.zeros(n), np.full(n, "", object)
            if own.names and letter.any():
                raw, starts = string_bytes(column)
                begin, end, row = words(raw, starts)
                _, first, back = word_kinds(raw, begin, end)
                logs = own.word_logs(raw, begin[first], end[first])
                # a document's words by kind
                pairs, times = np.unique(row << 32 | back, return_counts=True)
                share = own.mixtures(logs[pairs & 0xFFFFFFFF], pairs >> 32, n, times)
                best = share.argmax(axis=1)
                label[letter] = np.array(own.names, object)[best[letter]]
                score[letter] = np.clip(share[np.arange(n), best][letter], 0.0, 1.0)
                for i in np.flatnonzero(letter):
                    mixture[i] = ",".join(f"{own.names[j]}:{share[i, j]:.3f}" for j in np.argsort(-share[i], kind="stable") if share[i, j] > 0)
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), piece.column(1), pa.array(label, pa.string()), pa.array(score), pa.array(mixture, pa.string())], names=names)

    return run


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from all rows with a language. It has at most BUCKETS counts for a language; languages must be MOST_LANGUAGES at most."""
    taught = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = taught.mapInArrow(_learned, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = parts.toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; a model holds {MOST_LANGUAGES}")
    counts = np.zeros((BUCKETS, len(names)))
    place = {name: i for i, name in enumerate(names)}
    if table.num_rows:
        counts[table.column("bucket").to_numpy(), [place[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    return Model(names, counts)


def identify(docs: DataFrame, held_out, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score, mixture), learned from the rows where held_out isn't true.

    mixture lists language:proportion of the set chosen, largest first.
    """
    small_batches(docs.sparkSession)
    held = F.coalesce(held_out, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.where(~held), text, lang))
    out = docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text")).mapInArrow(_predicted(model), "doc_id long, held_out boolean, lang_pred string, score double, mixture string")
    return out.withColumnRenamed("doc_id", key)


def op4_language_mixture(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold("doc_id", 4) == 2)
