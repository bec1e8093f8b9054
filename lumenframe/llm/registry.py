"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from . import decontamination, jaccard, language_model, licenses, merkle, mixing, neighbours, secret_scan, suffix_arrays, suffix_automata, toxicity, urls, whitening

QUERIES = {
    "op1_decontaminate": decontamination.op1_decontaminate,
    "op2_url_filter": urls.op2_url_filter,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_suffix_dedup": suffix_arrays.op5_suffix_dedup,
    "op6_licenses": licenses.op6_licenses,
    "op7_secrets": secret_scan.op7_secrets,
    "op8_mix": mixing.op8_mix,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_substring_dedup": suffix_automata.op10_substring_dedup,
    "op11_language_model": language_model.op11_language_model,
    "op12_whitening": whitening.op12_whitening,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLE_SQL = {
    "op1_decontaminate": decontamination.OP1_SQL,
    "op6_licenses": licenses.OP6_SQL,
    "op8_mix": mixing.OP8_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
