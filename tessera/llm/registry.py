"""The queries of this subpackage, and SQL for those that SQL can express."""
from __future__ import annotations

from pyspark.sql import DataFrame

from .sentencepiece_sampling import encode
from .common import documents
from . import decontamination, license_scan, lm_scoring, near_dedup, pii, quality_classifier, quality_rules, substring_dedup, toxicity


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, lossless, ids) of every document; null and empty texts have no pieces."""
    return encode(documents(spark, sf_dir))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_pii": pii.op6_pii,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {"op8_quality_rules": quality_rules.OP8_SQL, "op9_decontamination": decontamination.OP9_SQL, "op7_substring_dedup": substring_dedup.OP7_SQL}
