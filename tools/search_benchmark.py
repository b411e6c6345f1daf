"""How often a fuzzy search finds a misspelt name, and how long a search takes, over a countries file.

    python tools/search_benchmark.py countries.tsv [searches]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from gazelark.functions import typos
from gazelark.plans.registries import Countries
from gazelark.session import local_session


def main(path: str, searches: int = 1000) -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8)
    countries = Countries.read(spark, path)
    n = len(countries)
    drawn = spark.range(searches).select(F.col("id").alias("qid"), (F.pmod(F.xxhash64("id"), F.lit(n)) + 1).alias("wanted"))
    asked = drawn.join(countries.table.select(F.col("id").alias("wanted"), "name"), "wanted").select("qid", "wanted", typos.with_typos(F.col("name"), F.col("qid")).alias("query"))
    asked = asked.cache()
    asked.count(), countries.index.postings.count()
    for limit in (1, 10):
        began = time.time()
        found = countries.search(asked.select("qid", "query"), limit=limit).select("qid", "id", "score").collect()
        took = time.time() - began
        wanted = {r["qid"]: r["wanted"] for r in asked.collect()}
        hits = {r["qid"] for r in found if r["id"] == wanted[r["qid"]]}
        print(f"first {limit}: {len(hits) / len(wanted):.3f} of {len(wanted)} searches found, {1000 * took / len(wanted):.2f} ms a search in one batch")


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
