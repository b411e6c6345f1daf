"""Packing documents into token windows by minimum bin slack.

Each task packs the documents that it reads, BLOCK at a time, so nothing is shuffled and memory is bounded by a block. A
document is its token ids and an end id. What is longer than a window gives whole windows and a rest. Over the block's rests a
bitset tells which sums up to the window are reachable: bit s of row i is set if the first i lengths (each so often as it
occurs) can add up to s. The highest bit is the window with least slack; walking the rows back gives how many rests of each
length make it up. If slack is left, a rest is cut to fill it exactly; what is left of the block at last is cut into powers
of two, which need no padding.

Cases: a null or empty text is just its end id; very long texts give as many windows as they fill; repeated rows are packed
each; an empty table gives an empty result; other columns are ignored. Sequence ids are the task's number and a count, the
same for a rerun over the same files.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._shared import slices, small_batches, string_bytes, word_kinds, words

WINDOW, BLOCK, END_ID = 2048, 512, 1
#: Word kinds whose ids a worker keeps; beyond it those go that weren't met again.
KEPT_KINDS = 1 << 18
#: How a tokenizer parts words, so that a run of letters is one part and a mark after a letter or digit begins another.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_PLAIN[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def without_marks(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a last mark after an ASCII letter or digit as a word of its own."""
    marked = np.flatnonzero((end - begin > 1) & _MARK[raw[end - 1]] & _PLAIN[raw[end - 2]])
    end = end.copy()
    end[marked] -= 1
    at = marked + 1
    return np.insert(begin, at, end[marked]), np.insert(end, at, end[marked] + 1), np.insert(row, at, row[marked])


class Ids:
    """Token ids of texts. A tokenizer that never joins what white space parts is asked once for each word that isn't kept, by its bytes."""

    def __init__(self, path: str, by_word: bool = True):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        parts = config.get("pre_tokenizer") or {}
        alone = [t for t in config.get("added_tokens") or [] if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].startswith("<|")]
        self.parting = (alone[0]["content"], alone[0]["id"]) if alone else None
        first = (parts.get("pretokenizers") or [parts])[0]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.letters_apart = bool(suffix) and first.get("type") == "Split" and first["pattern"].get("Regex") == LETTERS_APART
        if self.letters_apart:
            closing = {token: i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)}
            self.closes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            self.closes[list(closing.values())] = True
            # any byte can close a word
            self.letters_apart = sum(len(token) == len(suffix) + 1 for token in closing) >= 256
        self.place: dict[bytes, int] = {}
        self.start, self.size, self.again = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, bool)
        self.flat, self.used = np.zeros(1 << 12, np.uint32), 0

    def _thin(self) -> None:
        """Keep the words that were met again since the last time, three quarters of KEPT_KINDS at most."""
        keep = np.flatnonzero(self.again[: len(self.place)])[-(KEPT_KINDS * 3 // 4) :]
        names = list(self.place)  # by place
        start, size = self.start[keep], self.size[keep]
        ends = np.cumsum(size)
        self.used = int(size.sum())
        self.flat = self.flat[np.repeat(start - ends + size, size) + np.arange(self.used)]
        self.place = {names[i]: place for place, i in enumerate(keep.tolist())}
        self.start, self.size, self.again = ends - size, size, np.zeros(len(keep), bool)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _sized(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids end to end, and how many each has; many at once, parted by a special token, which no word holds."""
        if self.parting:
            name, own = self.parting
            flat = np.concatenate(self.whole(["".join([w + name for w in new[i : i + 512]]) for i in range(0, len(new), 512)]))
            cuts = np.flatnonzero(flat == own)
            if len(cuts) == len(new):
                return flat[flat != own], np.diff(cuts, prepend=-1) - 1
        ids = self.whole(new)
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _sized_letters(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, many at once: where as many ids close a word as there are words, each has one part, whose last id closes it."""
        parts = [new[i : i + 512] for i in range(0, len(new), 512)]
        out = []
        for part, flat in zip(parts, self.whole([" ".join(part) for part in parts]), strict=True):
            ends = np.flatnonzero(self.closes[flat]) + 1
            out.append((flat, np.diff(ends, prepend=0)) if len(ends) == len(part) and ends[-1] == len(flat) else self._sized(part))
        return np.concatenate([flat for flat, _ in out]), np.concatenate([size for _, size in out])

    def _learn(self, new: list[bytes]) -> None:
        texts = [w.decode() for w in new]
        letters = [self.letters_apart and t.isalpha() for t in texts]
        for some, sized in ((True, self._sized_letters), (False, self._sized)):
            if part := [i for i, x in enumerate(letters) if x is some]:
                self._add([new[i] for i in part], *sized([texts[i] for i in part]))

    def _add(self, new: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        first, total = len(self.place), int(size.sum())
        for name, need in (*((name, first + len(new)) for name in ("start", "size", "again")), ("flat", self.used + total)):
            array = getattr(self, name)
            if need > len(array):
                setattr(self, name, np.concatenate([array, np.zeros(max(need - len(array), len(array)), array.dtype)]))
        self.start[first : first + len(new)] = self.used + np.cumsum(size) - size
        self.size[first : first + len(new)] = size
        self.flat[self.used : self.used + total] = ids
        self.used += total
        self.place.update(zip(new, range(first, first + len(new)), strict=True))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids end to end, each row's closed by END_ID, and where each row starts."""
        raw, starts = string_bytes(column)
        data = raw.tobytes()
        # a special token's name is told by case, and words are looked up without it
        if not self.by_word or b"<|" in data:
            rows = [np.append(x, np.uint32(END_ID)) for x in self.whole([t or "" for t in column.to_pylist()])]
            return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        begin, end, row = words(raw, starts)
        if self.letters_apart:
            begin, end, row = without_marks(raw, begin, end, row)
        _, one, back = word_kinds(raw, begin, end)
        low = data.lower()  # A-Z alone, as these are bytes
        kinds = [low[a:b] for a, b in zip(begin[one].tolist(), end[one].tolist(), strict=True)]
        if len(self.place) + len(kinds) > KEPT_KINDS:
            self._thin()
        at = np.fromiter(map(self.place.get, kinds, repeat(-1)), np.int64, len(kinds))
        unknown = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(unknown):
            new = [kinds[i] for i in unknown.tolist()]
            self._learn(new)
            at[unknown] = [self.place[w] for w in new]
        kind = at[back]
        size = self.size[kind]
        # END_ID after each row's words
        per_row = np.bincount(row, weights=size, minlength=len(column)).astype(np.int64) + 1
        bounds = np.concatenate([[0], np.cumsum(per_row)])
        out = np.full(bounds[-1], END_ID, np.uint32)
        before = np.cumsum(size) - size
        run = np.arange(int(size.sum()))
        pick = np.repeat(self.start[kind] - before, size) + run
        out[np.repeat(row, size) + run] = self.flat[pick]
        return out, bounds


_kept: dict[tuple[str, bool], Ids] = {}


def ids_of(path: str, by_word: bool) -> Ids:
    """The worker's own, which later tasks find filled."""
    if (path, by_word) not in _kept:
        _kept.clear()
        _kept[path, by_word] = Ids(path, by_word)
    return _kept[path, by_word]


def least_slack(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length make up the largest sum that room holds."""
    every = (1 << (room + 1)) - 1
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    reach = [1]
    used: list[tuple[int, int]] = []
    for length in lengths:
        left, part = min(counts[length], room // length), 1
        while left:  # a length's count in doubling parts, so that a row for each part is enough
            part = min(part, left)
            used.append((length, part))
            reach.append(reach[-1] | (reach[-1] << (length * part)) & every)
            left -= part
            part *= 2
        if reach[-1] >> room & 1:
            break
    total = reach[-1].bit_length() - 1
    taken: dict[int, int] = {}
    for i in range(len(used), 0, -1):
        if reach[i - 1] >> total & 1:
            continue
        length, part = used[i - 1]
        taken[length] = taken.get(length, 0) + part
        total -= length * part
    return taken


def pack(sizes: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of these many tokens."""
    out: list[list[tuple[int, int, int]]] = []
    rests: dict[int, list[tuple[int, int]]] = {}
    for doc, size in enumerate(sizes):
        full = size // window
        out += [[(doc, i * window, window)] for i in range(full)]
        if size % window:
            rests.setdefault(size % window, []).append((doc, full * window))
    left = sum(length * len(x) for length, x in rests.items())
    while left >= window:
        taken = least_slack({length: len(x) for length, x in rests.items()}, window)
        sequence = []
        for length, n in taken.items():
            sequence += [(*rests[length].pop(), length) for _ in range(n)]
            if not rests[length]:
                del rests[length]
        slack = window - sum(x[2] for x in sequence)
        if slack:  # no rest is so short; the longest gives the beginning
            longest = max(rests)
            doc, start = rests[longest].pop()
            if not rests[longest]:
                del rests[longest]
            sequence.append((doc, start, slack))
            rests.setdefault(longest - slack, []).append((doc, start + slack))
        out.append(sequence)
        left -= window
    # what is left goes, in order, into powers of two
    queue = [(doc, start, length) for length in sorted(rests, reverse=True) for doc, start in rests[length]]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        sequence = []
        while room:
            doc, start, length = queue.pop(0)
            part = min(length, room)
            sequence.append((doc, start, part))
            room -= part
            if part < length:
                queue.insert(0, (doc, start + part, length - part))
        out.append(sequence)
    return out


def _packed(path: str, window: int, block: int, by_word: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        ids = ids_of(path, by_word)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        keys: list[int | None] = []
        held: list[np.ndarray] = []

        def flush():
            nonlocal number
            columns: list[list] = [[] for _ in names]
            for sequence in pack([len(x) for x in held], window):
                offset = 0
                for doc, start, length in sequence:
                    crc = zlib.crc32(held[doc][start : start + length].tobytes())
                    for c, v in zip(columns, (keys[doc], start, length, crc, len(held[doc]), number, offset), strict=True):
                        c.append(v)
                    offset += length
                number += 1
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for piece in slices(batches, 1, 1 << 20):
            flat, bounds = ids(piece.column(1))
            for i, key in enumerate(piece.column(0).to_pylist()):
                keys.append(key)
                held.append(flat[bounds[i] : bounds[i + 1]])
                if len(held) >= block:
                    yield flush()
        if held:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, block: int = BLOCK, by_word: bool = True) -> DataFrame:
    """One row a piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    by_word: the tokenizer's ids for a text are those of its words parted by ASCII white space, whatever stands around
    them and however A to Z are cased.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    small_batches(docs.sparkSession)
    packed = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(_packed(tokenizer_path, window, block, by_word), schema)
    return packed.withColumnRenamed("doc_id", key)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_min_slack_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe())
