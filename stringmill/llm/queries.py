"""The queries of this subpackage and their SQL, for the driver's contract."""

from __future__ import annotations

from . import decontaminate, htmltext, line_dedup, neardup, neighbours, packing, quality_rules, rule_ensemble, simple8b, spelling, toxicity, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_crf_extraction": htmltext.op3_crf_extraction,
    "op4_rule_ensemble": rule_ensemble.op4_rule_ensemble,
    "op5_warc": warc.op5_warc,
    "op6_cgk_decontamination": decontaminate.op6_cgk_decontamination,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_superminhash": neardup.op8_superminhash,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simple8b": simple8b.op10_simple8b,
    "op11_balanced_lists": neighbours.op11_balanced_lists,
    "op12_spelling_variants": spelling.op12_spelling_variants,
}

ORACLE_SQL = {"op2_line_dedup": line_dedup.ORACLE_SQL, "op12_spelling_variants": spelling.ORACLE_SQL}
