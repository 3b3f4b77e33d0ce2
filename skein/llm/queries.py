"""The queries of this subpackage, by name."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, jaccard, licenses, lines, mixing, pii, quality, sharding, subwords, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_sharding": sharding.op2_sharding,
    "op3_pii": pii.op3_pii,
    "op4_warc": warc.op4_warc,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_quality_rules": quality.op6_quality,
    "op7_lm_scoring": subwords.op7_lm_scoring,
    "op8_mixing": mixing.op8_mixing,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_decontamination": decontaminate.op10_decontamination,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {}
