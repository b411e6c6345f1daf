"""Full-text matching ranked by BM25 over a positional inverted index, all as joins and aggregates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_tokens, tokens
from ..sources import tables
from ..spec import EntitySpec

#: BM25's parameters, the weight of a table's first field, and what stands for a score that would not be above 0.
K1, B, FIRST_WEIGHT, LEAST_IDF = 1.2, 0.75, 50.0, 1e-6


@dataclass
class TextIndex:
    """postings: (token, field, id, pos), pos counting on over the values of an alias field; sizes: (id, size) in tokens of all fields."""

    spec: EntitySpec
    postings: DataFrame
    sizes: DataFrame
    _totals: tuple[int, float] | None = field(default=None, repr=False)
    found: DataFrame | None = field(default=None, repr=False)

    @classmethod
    def build(cls, df: DataFrame, spec: EntitySpec) -> TextIndex:
        """One pass over the table, without a shuffle."""

        def placed(field: str) -> Column:
            return F.transform(tokens(F.col(field).cast("string")), lambda t, i: F.struct(t.alias("token"), F.lit(field).alias("field"), i.alias("pos")))

        each = [placed(f) for f in spec.text_fields]
        return cls._of(df.select(F.col(spec.key).alias("id"), F.flatten(F.array(*each)).alias("t")), spec)

    @classmethod
    def _of(cls, found: DataFrame, spec: EntitySpec) -> TextIndex:
        """From (id, t), each row's placed tokens."""
        postings = found.select("id", F.explode("t").alias("t")).select("t.token", "t.field", "id", "t.pos")
        return cls(spec, postings, found.select("id", F.size("t").alias("size")), found=found)

    def cached(self) -> TextIndex:
        return TextIndex(self.spec, self.postings.cache(), self.sizes.cache())

    def write(self, path: str) -> None:
        """Postings sorted by token, so that a lookup reads the row groups of its tokens.

        Texts are split once, into a table that the sample for the ranges, the postings and the sizes read. Ranges go by id too, so
        that no task gets all of a frequent token.
        """
        index, spark = self, self.postings.sparkSession
        if self.found is not None:
            self.found.write.mode("overwrite").parquet(f"{path}/found")
            index = self._of(spark.read.schema(self.found.schema).parquet(f"{path}/found"), self.spec)
        index.postings.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{path}/postings")
        index.sizes.write.mode("overwrite").parquet(f"{path}/sizes")
        if index is not self:
            tables.remove(spark, f"{path}/found")

    @classmethod
    def read(cls, spark, path: str, spec: EntitySpec) -> TextIndex:
        return cls(spec, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/sizes"))

    def totals(self) -> tuple[int, float]:
        """Rows, and mean size."""
        if self._totals is None:
            row = self.sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
            self._totals = row["n"], row["mean"] or 0.0
        return self._totals


def phrases(text: str, exact: bool = True) -> list[tuple[list[str], bool]]:
    """(tokens, whether the last one is a prefix) for each word of a query; a word with punctuation is a phrase of its parts."""
    words = text.split()
    if not words:
        raise ValueError("a query of white space only")
    if any('"' in w for w in words):
        raise ValueError("a quotation mark in a query")
    return [(parts, not exact) for w in words if (parts := py_tokens(w))]


def _hits(index: TextIndex, parts: list[str], prefix: bool, only: str | None) -> DataFrame:
    """(id, field, pos) where the phrase starts."""
    postings = index.postings.where(F.col("field") == only) if only else index.postings

    def of(i: int) -> Column:
        return F.col("token").startswith(parts[i]) if prefix and i == len(parts) - 1 else F.col("token") == parts[i]

    out = postings.where(of(0)).select("id", "field", "pos")
    for i in range(1, len(parts)):
        out = out.join(postings.where(of(i)).select("id", "field", (F.col("pos") - i).alias("pos")), ["id", "field", "pos"], "left_semi")
    return out


def fts_match(index: TextIndex, query: str | None = None, fields: dict[str, str] | None = None, exact: bool = True) -> DataFrame:
    """(id, rank) of the rows that hold all words; a lower rank is better.

    With fields, each column must hold all of its own words, and the query doesn't count. Otherwise each word may be in any column.
    """
    if fields:
        if any(not v.split() for v in fields.values()):
            raise ValueError("a blank text for a column")
        wanted = [(f, *p) for f, v in fields.items() for p in phrases(v, exact)]
        # a column whose words are all punctuation can't match
        if any(not phrases(v, exact) for v in fields.values()):
            wanted = []
    else:
        wanted = [(None, *p) for p in phrases(query, exact)] if query else []
    if not wanted:
        return index.sizes.select("id", F.lit(0.0).alias("rank")).limit(0)
    first = index.spec.text_fields[0]
    each = None
    for i, (only, parts, prefix) in enumerate(wanted):
        one = _hits(index, parts, prefix, only).groupBy("id").agg(F.sum(F.when(F.col("field") == first, FIRST_WEIGHT).otherwise(1.0)).alias("tf")).withColumn("phrase", F.lit(i))
        each = one if each is None else each.unionByName(one)
    return ranked(each, index, len(wanted))


def ranked(each: DataFrame, index: TextIndex, wanted: int) -> DataFrame:
    """(id, rank) of the rows with all phrases, from (id, phrase, tf)."""
    rows, mean = index.totals()
    # a row for each phrase of the query
    spread = each.groupBy("phrase").agg(F.count("*").alias("n"))
    idf = F.log((rows - F.col("n") + 0.5) / (F.col("n") + 0.5))
    scored = each.join(F.broadcast(spread), "phrase").join(index.sizes, "id")
    part = F.when(idf > 0, idf).otherwise(LEAST_IDF) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0)))
    return scored.groupBy("id").agg(F.count("*").alias("found"), (-F.sum(part)).alias("rank")).where(F.col("found") == wanted).select("id", "rank")


def filtered(df: DataFrame, index: TextIndex, query: str | None = None, limit: int | None = None, offset: int | None = None, order_by: tuple[str, ...] = ("rank",), exact: bool = True, **given) -> DataFrame:
    """Rows of df by full-text match, with their rank. Unknown arguments give no rows, as does nothing to look for."""
    spec = index.spec
    if limit == 0 or offset == 0 or (offset and limit is None):
        raise ValueError("a limit of 0, an offset of 0 and an offset without a limit aren't allowed")
    if any(k not in spec.filters for k in given):
        return df.withColumn("rank", F.lit(0.0)).limit(0)
    fields = {spec.filters[k]: v for k, v in given.items() if v is not None}
    if not fields and not query:
        return df.withColumn("rank", F.lit(0.0)).limit(0)
    found = fts_match(index, query, fields or None, exact)
    out = df.join(found, df[spec.key] == found["id"]).drop(found["id"]).orderBy(*order_by, spec.key)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out
