"""Texts with typing errors, for measuring a search: deterministic for a seed, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import _let

#: Shortest text that is changed; characters changed, as a share of its length, one at least.
SHORTEST, SHARE = 4, 0.075


def with_typos(c: Column, seed: Column, share: float = SHARE) -> Column:
    """The text with a share of its letters doubled, dropped or swapped with the next one, at places that the seed gives; the first letter stays.

    seed: a column or literal that tells one misspelling of a text from another.
    """
    changes = F.greatest(F.lit(1), F.floor(F.length(c) * share).cast("int"))

    def change(text: Column, i: Column) -> Column:
        # 2 to length - 1, so that a next letter is there
        place = lambda draw: (F.pmod(draw, F.greatest(F.length(text) - 2, F.lit(1))) + 2).cast("int")
        drawn = _let(F.pmod(F.xxhash64(text, seed, i), F.lit(1 << 20)), lambda draw: F.struct(place(draw).alias("at"), (F.floor(draw / 1024) % 3).alias("kind")))
        return _let(drawn, lambda d: changed(text, d["at"], d["kind"]))

    def changed(text: Column, at: Column, kind: Column) -> Column:
        head, letter, after, rest = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.lit(1)), F.substring(text, at + 1, F.lit(1)), F.substring(text, at + 2, F.length(text))
        return F.when(kind == 0, F.concat(head, letter, letter, after, rest)).when(kind == 1, F.concat(head, after, rest)).otherwise(F.concat(head, after, letter, rest))

    return F.when(F.length(c) < SHORTEST, c).otherwise(F.aggregate(F.sequence(F.lit(1), changes), c, change))
