"""The queries of this subpackage and their SQL (none where SQL cannot express the method; tests hold those)."""

from __future__ import annotations

from . import audit, merkle, mixing, neardup, packing, pii, quality, secrets, substring, tokens, topk, toxicity, urls

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_pii_sanitise": pii.op3_pii_sanitise,
    "op4_url_filter": urls.op4_url_filter,
    "op5_minhash_neardup": neardup.op5_minhash_neardup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_topk_nra": topk.op7_topk_nra,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_token_counts": tokens.op11_token_counts,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
SQL = {
    "op1_substring_dedup": substring.op1_sql(),
    "op2_secret_scan": secrets.op2_sql(),
    "op3_pii_sanitise": pii.op3_sql(),
    "op5_minhash_neardup": neardup.op5_sql(),
    "op7_topk_nra": topk.op7_sql(),
    "op8_mix_sources": mixing.op8_sql(),
    "op10_quality_rules": quality.op10_sql(),
    "op12_filter_audit": audit.op12_sql(),
    "op13_merkle_manifest": merkle.op13_sql(),
}
