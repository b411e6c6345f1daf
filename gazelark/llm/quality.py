"""Quality rules by host, with DataFrame functions only.

Each document is measured and held against rules. Rule failures are added up by host; a host's failure rate is shrunk
towards the rate of all hosts by a beta prior fitted to the hosts' own rates (method of moments), so that a host of few
documents isn't judged by them alone. The host verdicts are joined back: on a rejected host only documents that break
no rule at all stay; on other hosts a document goes only if it breaks a base rule.

Cases: a null text has no words; a null host is a host of its own; repeated rows and rows of one key count each and get a verdict each; a
very long text takes room for its words in one row; an empty table gives an empty result; other columns are ignored. The rule on
repeated lines takes ten words as a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD, written

#: Base rules, then the further rules whose failures count for the host.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MAX_SYMBOLS_PERCENT, MAX_DUP_LINES_PERCENT, MIN_WORD_CHARS, MAX_WORD_CHARS = 10, 30, 2, 25
#: A host is rejected if its shrunk failure rate is above this.
REJECT_ABOVE = 0.5
WINDOW = 5


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """How many words stand in WINDOW-word windows that occur twice or more.

    Windows are hashed; if all hashes differ, the answer is 0. Otherwise (hash, position) pairs are sorted, those with an
    equal neighbour are kept, and each such window adds the words up to the next such window, WINDOW at most.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twin = _let(
            pairs,
            lambda p: F.array_sort(
                F.transform(
                    F.filter(F.transform(p, lambda x, k: F.struct(x["i"].alias("i"), (F.get(p, k - 1)["h"].eqNullSafe(x["h"]) | F.get(p, k + 1)["h"].eqNullSafe(x["h"])).alias("t"))), lambda x: x["t"]),
                    lambda x: x["i"],
                )
            ),
        )
        gaps = _let(twin, lambda t: F.transform(t, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(t, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(
        words,
        lambda w: F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))),
    )


def measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeated_words(words).cast("long"),
    }


def rules() -> tuple[Column, Column]:
    """(base_failed, failed) from the measures."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    more = (
        (100 * F.col("n_symbols") > MAX_SYMBOLS_PERCENT * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.greatest(F.lit(1), F.col("n_words") / 10))
        | (F.col("word_chars") < MIN_WORD_CHARS * F.col("n_words"))
        | (F.col("word_chars") > MAX_WORD_CHARS * F.col("n_words"))
    )
    return base, base | more


def measured(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """(doc_id, host, the measures, base_failed, failed)."""
    out = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), *[c.alias(n) for n, c in measures(F.col(text)).items()])
    base, failed = rules()
    return out.withColumn("base_failed", base).withColumn("failed", failed)


def host_verdicts(marked: DataFrame, reject_above: float = REJECT_ABOVE) -> DataFrame:
    """(host, n, fails, rate, host_rejected): failures by host, the rate shrunk by the beta prior of all hosts.

    Hosts' sums are partial aggregates, so a host of a third of all rows is one row a task when it is shuffled. The prior's two
    moments are sums over hosts, one row, which goes to every host's row as a constant.
    """
    hosts = written(marked.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("fails")))
    raw = F.col("fails") / F.col("n")
    moments = hosts.agg(F.avg(raw).alias("mean"), F.coalesce(F.avg(raw * raw) - F.avg(raw) * F.avg(raw), F.lit(0.0)).alias("var")).first()
    mean, var = (moments["mean"] or 0.0), max(moments["var"] or 0.0, 1e-4)
    strength = max(2.0, mean * (1 - mean) / var - 1)  # hosts that differ more than a beta can tell leave the weakest prior
    return hosts.select("host", "n", "fails", ((F.col("fails") + mean * strength) / (F.col("n") + strength)).alias("rate")).withColumn("host_rejected", F.col("rate") > reject_above)


def quality(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rejected)."""
    marked = written(measured(docs, text, host, key))
    verdicts = host_verdicts(marked)
    out = marked.alias("d").join(verdicts.alias("v"), F.col("d.host").eqNullSafe(F.col("v.host")))
    kept = ~F.col("base_failed") & ~(F.col("host_rejected") & F.col("failed"))
    return out.select(F.col("doc_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rejected")


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that stay, with docs' own columns. The rules' verdicts are written beside the texts, so texts aren't shuffled."""
    base, failed = rules()
    facts = docs.select(F.struct("*").alias("row"), F.col(host).alias("host"), *[c.alias(n) for n, c in measures(F.col(text)).items()])
    marked = written(facts.select("row", "host", base.alias("base_failed"), failed.alias("failed")))
    verdicts = host_verdicts(marked.select("host", "failed")).where("host_rejected").select(F.col("host").alias("bad"))
    clean, rest = ~F.col("failed"), F.col("failed") & ~F.col("base_failed")
    kept = marked.where(rest).join(verdicts, F.col("host").eqNullSafe(F.col("bad")), "left_anti").select("row.*")
    return marked.where(clean).select("row.*").unionByName(kept)


def op2_host_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Measures and verdict in SQL; {docs} is a table with doc_id, text and source.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM {docs}),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS l FROM d),
grams AS (
  SELECT doc_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) > 4)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (
  SELECT w.doc_id, w.source, len(w.w)::BIGINT AS n_words, length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines.l) - len(list_distinct(lines.l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (
  SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * greatest(1, n_words / 10)
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words AS failed FROM b),
hosts AS (SELECT source, count(*) AS n, sum(failed::INT) AS fails FROM f GROUP BY source),
prior AS (SELECT avg(fails / n) AS mean, greatest(avg((fails / n) * (fails / n)) - avg(fails / n) * avg(fails / n), 1e-4) AS var FROM hosts),
strength AS (SELECT mean, greatest(2.0, mean * (1 - mean) / var - 1) AS k FROM prior),
verdicts AS (SELECT source, (fails + mean * k) / (n + k) > 0.5 AS host_rejected FROM hosts, strength)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (host_rejected AND failed) AS kept, host_rejected
FROM f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
"""
