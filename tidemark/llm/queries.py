"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from tidemark.llm import decontamination, lines, lm_scoring, near, oracles, packing, phrases, pii, quality, runs, search, secrets, toxicity, urls

QUERIES = {
    "op1_url_filters": urls.op1_url_filters,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_repeated_phrases": phrases.op3_repeated_phrases,
    "op4_near_duplicates": near.op4_near_duplicates,
    "op5_line_spread": lines.op5_line_spread,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_pii": pii.op11_pii,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_ranked_search": search.op13_ranked_search,
}

ORACLES = {
    "op1_url_filters": urls.ORACLE, "op3_repeated_phrases": oracles.REPEATED_PHRASES, "op4_near_duplicates": oracles.NEAR_DUPLICATES,
    "op5_line_spread": oracles.LINE_SPREAD, "op7_quality_rules": quality.ORACLE,
    "op11_pii": pii.ORACLE, "op12_periodic_runs": runs.ORACLE, "op13_ranked_search": search.ORACLE,
}
