"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import images, jaccard, langid, licenses, mixing, packing, pii, ppm, quality, repeats


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_pii_offsets": pii.op1_pii_offsets,
        "op2_host_quality": quality.op2_host_quality,
        "op3_license_compression": licenses.op3_license_compression,
        "op4_language_mixture": langid.op4_language_mixture,
        "op5_suffix_repeats": repeats.op5_suffix_repeats,
        "op6_fair_queue_mix": mixing.op6_fair_queue_mix,
        "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
        "op8_min_slack_packing": packing.op8_min_slack_packing,
        "op9_image_descriptors": images.op9_image_descriptors,
        "op10_ppm_score": ppm.op10_ppm_score,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_host_quality": quality.OP2_SQL.replace("{docs}", "documents"),
        "op6_fair_queue_mix": mixing.OP6_SQL,
    }
