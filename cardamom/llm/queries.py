"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, collocations, decontaminate, filter_audit, jaccard, language_id, licenses, quality, secret_scan, sharding, token_files, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_ring_shards": sharding.op6_ring_shards,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_language_id": language_id.op10_language_id,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_collocations": collocations.op12_collocations,
    "op13_token_files": token_files.op13_token_files,
}

ORACLES = {
    "op8_ngram_jaccard": jaccard.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
}
