"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result and reads it for the next. All
but the last return the columns of documents.

Cases, for every stage: an empty table gives an empty result; rows without doc_id stay and are nobody's copies; null and empty
texts are short texts to the quality rules, alone to the near-duplicates, without personal data, never taken by the mix and just an end id when
packed; rows with one doc_id are the parts of one document; of rows equal in doc_id and text one stays; further columns go along,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazelark.llm import jaccard, mixing, packing, pii, quality
from gazelark.llm._shared import dropped, written

#: Near-duplicates: shingles of so many words, and the similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their host's verdict keep."""
    return quality.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id, with all its rows that differ in text. Rows without doc_id stay."""
    groups = jaccard.jaccard_components(docs.select("doc_id", "text"), k=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id IS NULL"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it."""
    return mixing.take(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents by sequence and offset."""
    return packing.pack_documents(docs, packing.word_bpe())


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Near-duplicate groups, transducers and a tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
