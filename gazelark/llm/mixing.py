"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source's documents stand in a hash-shuffled queue that may be passed up to max_epochs times. A copy's virtual
finish time is its source's words up to and with it, over the source's target; so all sources reach their target at
time 1. Copies are range-sorted by that time and taken until the whole budget is spent: ranges before the one in which it ends are
taken whole, and that one is ranged again until it has EDGE copies at most, whose order then decides.

Cases: a null text has size 0 and is never taken; a null source is a source of its own, last; repeated rows and rows of one key queue as
rows of their own; a very long text is one document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, written

#: Steps of virtual time below 8, and per doubling above: some ten thousand ranges, however large the input.
STEPS, STEPS_ABOVE = 1024, 64
#: Copies that are sorted by one task.
EDGE = 10_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target): the words of all sources shared by weight.

    A target stops at max_epochs times its source's size, the excess going to the others by weight: with sources by
    cap over weight, the first ones are capped and one rate serves the rest, the first rate that caps no other.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source from here on
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    named = totals.withColumn("rank", F.row_number().over(rank)).withColumn("weight", pick.cast("double")).withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return (
        named.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("rate", (F.col("total") - F.col("capped_before")) / (F.col("all_weight") - F.col("weight_before")))
        # the rate that holds is that of the first source whose cap it doesn't exceed
        .withColumn("held", F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("rank"), F.col("rate")))).over(everything))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("held.rate") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, budget: int | None = None) -> DataFrame:
    """(key, source, size, source_size, target, taken): taken is size times the copies that the mix takes.

    budget: words to take; all words of the input by default.
    """
    sized = written(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).withColumn("turn", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    )
    if budget is None:
        budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    # a hot source is dealt out by the start of its documents' turns; only sums of its parts meet
    lane = F.substring("turn", 1, 3)
    parts = sized.groupBy("source", lane.alias("lane")).agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "lane", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("start"))
    facts = source_targets(sized, weights, max_epochs)
    lanes = starts.alias("s").join(facts.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source"))).select("s.source", "lane", "start", "source_size", "target")
    in_lane = Window.partitionBy("source", "lane").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = sized.withColumn("lane", lane).withColumn("within", F.sum("size").over(in_lane))
    queued = (
        queued.alias("q")
        .join(lanes.alias("l"), F.col("q.source").eqNullSafe(F.col("l.source")) & (F.col("q.lane") == F.col("l.lane")))
        .select("doc_id", "q.source", "size", "turn", "source_size", "target", (F.col("start") + F.col("within")).alias("finish"))
    )
    queued = written(queued)
    copies = queued.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    copies = copies.withColumn("time", (F.col("epoch") * F.col("source_size") + F.col("finish")) / F.col("target"))
    cut = _cut(copies, budget)
    if cut is None:
        return queued.select(F.col("doc_id").alias(key), "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * max_epochs).otherwise(F.lit(0)).cast("long").alias("taken"))
    low, high, spent = cut
    # the range in which the budget ends is the only one whose order matters
    order = Window.orderBy("time", F.col("source").asc_nulls_last(), "turn", "doc_id", "size", "epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = copies.where(F.col("time").between(low, high)).withColumn("upto", F.sum("size").over(order) + F.lit(spent)).where(F.col("upto") <= budget)
    edge = edge.groupBy("doc_id", "source", "turn", "size", "finish").agg(F.count("*").alias("more"))
    whole = F.lit(0)
    for epoch in range(max_epochs):
        time = (F.lit(epoch) * F.col("source_size") + F.col("q.finish")) / F.col("target")
        whole = whole + F.when(time < low, 1).otherwise(0)
    joined = queued.alias("q").join(
        edge.alias("e"),
        (F.col("q.turn") == F.col("e.turn")) & F.col("q.doc_id").eqNullSafe(F.col("e.doc_id")) & F.col("q.source").eqNullSafe(F.col("e.source")) & (F.col("q.finish") == F.col("e.finish")) & (F.col("q.size") == F.col("e.size")),
        "left",
    )
    taken = F.when(F.col("q.size") > 0, F.col("q.size") * (whole + F.coalesce(F.col("more"), F.lit(0)))).otherwise(F.lit(0)).cast("long")
    return joined.select(F.col("q.doc_id").alias(key), F.col("q.source").alias("source"), F.col("q.size").alias("size"), "source_size", "target", taken.alias("taken"))


def identity(docs: DataFrame) -> Column:
    """128 bits of all of a row's columns, as text; maps, which have no hash, count as their JSON."""
    every = [F.to_json(F.col(f"`{name}`")) if kind.startswith("map<") else F.col(f"`{name}`") for name, kind in docs.dtypes]
    return F.concat(F.hex(F.xxhash64(*every)), F.hex(F.xxhash64(F.lit(6), *every[::-1])))


def take(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs' rows, each as often as the mix takes it. Rows equal in all columns are told apart by how often they are taken together."""
    row = identity(docs)
    mixed = mix(docs.select(F.col(text).alias("text"), F.col(source).alias("source"), row.alias("row")), key="row", **how)
    times = mixed.where("taken > 0").groupBy("row").agg(F.sum("taken").alias("words"), F.first("size").alias("size"))
    times = times.select("row", F.explode(F.sequence(F.lit(1), (F.col("words") / F.col("size")).cast("int"))).alias("copy"))
    # one of equal rows, then each as often as all of them are taken
    one = docs.select(row.alias("row"), F.struct("*").alias("all")).dropDuplicates(["row"])
    return one.join(times, "row").select("all.*")


def _range(time=None):
    """The range of a virtual time: even steps below 8, then steps of its logarithm."""
    time = F.col("time") if time is None else time
    return F.when(time < 8, F.floor(time * STEPS)).otherwise(8 * STEPS + F.floor(F.log2(F.greatest(time, F.lit(8.0)) / 8) * STEPS_ABOVE)).cast("long")


def _cut(copies: DataFrame, budget: int) -> tuple[float, float, int] | None:
    """The least and greatest time of the range in which the budget ends, and the words before it; None if all copies fit.

    A range is split by even steps of time while it has more than EDGE copies and more than one time. What it is split by never falls with time, so
    ranges are apart, and their own least and greatest times tell them.
    """
    inside, step, spent = copies, _range(), 0
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        sums = inside.groupBy(step.alias("range")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("time").alias("low"), F.max("time").alias("high"))
        row = sums.withColumn("upto", F.sum("words").over(before) + F.lit(spent)).where(F.col("upto") > budget).orderBy("range").first()
        if row is None:
            return None
        low, high, spent = row["low"], row["high"], row["upto"] - row["words"]
        if row["n"] <= EDGE or low == high:
            return low, high, spent
        inside = copies.where(F.col("time").between(low, high))
        step = F.floor((F.col("time") - F.lit(low)) * F.lit(STEPS / (high - low))).cast("long")


def op6_fair_queue_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS turn
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, 1.0::DOUBLE + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) AS weight,
         3 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals),
rated AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS rate
  FROM named WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT rate AS r FROM rated WHERE rate * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT r FROM held) * weight, cap::DOUBLE)) AS target FROM rated),
queued AS (
  SELECT s.doc_id, s.source, s.size, s.turn, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS finish
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, e.epoch, (e.epoch * source_size + finish)::DOUBLE / target AS time
  FROM queued q, (SELECT unnest([0, 1, 2]) AS epoch) e WHERE size > 0),
run AS (
  SELECT *, sum(size) OVER (ORDER BY time, source NULLS LAST, turn, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
counted AS (
  SELECT source, finish, count(*) AS n FROM run WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY source, finish)
SELECT q.doc_id, q.size, q.source_size, q.target, (CASE WHEN q.size > 0 THEN q.size * coalesce(c.n, 0) ELSE 0 END)::BIGINT AS taken
FROM queued q LEFT JOIN counted c ON q.source IS NOT DISTINCT FROM c.source AND q.finish = c.finish
"""
