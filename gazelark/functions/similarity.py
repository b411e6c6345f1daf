"""String similarity as Column builders, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Letters of b in one number.
_BLOCK = 62


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, bit-parallel: a zero in the row of bits for each letter of b that makes the best length grow.

    Each letter of a adds the bits where b has it to the row, block by block with the carry, so a pair costs the product of both lengths,
    less the letters that both begin or end with, which are always common.
    """
    full = (1 << _BLOCK) - 1

    def rows(by: Column, letters: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(letters) - 1) / _BLOCK).cast("int")), lambda w: F.slice(letters, w * _BLOCK + 1, F.lit(_BLOCK)))

        def step(row: Column, char: Column) -> Column:
            def block(acc: Column, w: Column) -> Column:
                bits = F.aggregate(F.transform(w["letters"], lambda x, i: F.when(x == char, F.call_function("shiftleft", F.expr("1L"), i)).otherwise(F.expr("0L"))), F.expr("0L"), lambda s, x: s + x)
                return _let(
                    F.struct(w["row"].alias("v"), bits.alias("m")),
                    lambda p: _let(
                        F.struct((p["v"] + p["v"].bitwiseAND(p["m"]) + acc["carry"]).alias("s"), p["v"].bitwiseAND(F.bitwise_not(p["m"])).alias("kept")),
                        lambda q: F.struct(F.shiftright(q["s"], _BLOCK).alias("carry"), F.concat(acc["out"], F.array(q["s"].bitwiseOR(q["kept"]).bitwiseAND(F.lit(full)))).alias("out")),
                    ),
                )

            start = F.struct(F.expr("0L").alias("carry"), F.array().cast("array<bigint>").alias("out"))
            return F.aggregate(F.transform(F.arrays_zip(row.alias("row"), blocks.alias("letters")), lambda z: F.struct(z["row"].alias("row"), z["letters"].alias("letters"))), start, block)["out"]

        last = F.aggregate(by, F.transform(blocks, lambda w: F.lit(full)), step)
        return F.aggregate(last, F.lit(0), lambda n, v: n + _BLOCK - F.bit_count(v))

    def alike(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False)
        return F.when(first == 0, F.size(x)).otherwise(first - 1).cast("int")

    def after(s: Column) -> Column:
        return F.struct(s["n"].alias("n"), *[F.reverse(F.slice(s[x], s["k"] + 1, F.size(s[x]))).alias(x) for x in "ab"])

    def counted(s: Column) -> Column:
        return F.struct((s["n"] + alike(s["a"], s["b"])).alias("n"), alike(s["a"], s["b"]).alias("k"), s["a"].alias("a"), s["b"].alias("b"))

    def middle(s: Column) -> Column:
        return s["n"] + F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0)).otherwise(rows(s["a"], s["b"]))

    split = F.struct(F.lit(0).alias("n"), F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    trimmed = _let(split, lambda s: _let(counted(s), lambda t: _let(after(t), lambda u: _let(counted(u), lambda v: _let(after(v), middle)))))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(trimmed)


def indel_distance(a: Column, b: Column) -> Column:
    """Insertions and deletions that turn a into b."""
    return F.length(a) + F.length(b) - 2 * common_subsequence(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """100 for equal texts, 0 for texts with nothing in common."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(100.0 * (1 - indel_distance(a, b) / total))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts as sets of words, 0 to 100: of the common words with either rest, and of both rests beside them."""
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != "")))

    def compare(s: Column) -> Column:
        common, left, right = F.array_join(s["common"], " "), F.array_join(s["left"], " "), F.array_join(s["right"], " ")
        n, la, lb = F.length(common), F.length(left), F.length(right)
        gap = F.when(n > 0, 1).otherwise(0)
        rest = 1 - indel_distance(left, right) / (2 * (n + gap) + la + lb)
        one = lambda x: F.when(n > 0, 1 - (gap + x) / (2 * n + gap + x)).otherwise(F.lit(0.0))
        return (
            F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0))
            .when((n > 0) & ((la == 0) | (lb == 0)), F.lit(100.0))
            .otherwise(100.0 * F.greatest(rest, one(la), one(lb)))
        )

    sets = _let(F.struct(words(a).alias("a"), words(b).alias("b")), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.array_intersect(s["a"], s["b"]).alias("common"), F.array_except(s["a"], s["b"]).alias("left"), F.array_except(s["b"], s["a"]).alias("right")))
    return _let(sets, compare)
