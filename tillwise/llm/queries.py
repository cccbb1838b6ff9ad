"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tillwise.llm import (
    attention_lm,
    decontaminate,
    group_join,
    html_text,
    line_dedup,
    mixing,
    quality_gam,
    resample,
    rules,
    runs,
    secrets,
    suffix_dedup,
    token_files,
)

QUERIES = {
    "op1_range_ans": token_files.op1_range_ans,
    "op2_curriculum_mix": mixing.op2_curriculum_mix,
    "op3_template_extract": html_text.op3_template_extract,
    "op4_attention_score": attention_lm.op4_attention_score,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_gam_quality": quality_gam.op6_gam_quality,
    "op7_wu_manber": decontaminate.op7_wu_manber,
    "op8_robust_rules": rules.op8_robust_rules,
    "op9_entropy_secrets": secrets.op9_entropy_secrets,
    "op10_group_join": group_join.op10_group_join,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_importance_draw": resample.op12_importance_draw,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}

ORACLE_SQL = {
    "op2_curriculum_mix": mixing.OP2_SQL,
    "op7_wu_manber": decontaminate.OP7_SQL,
    "op10_group_join": group_join.OP10_SQL,
    "op11_periodic_runs": runs.OP11_SQL,
    "op12_importance_draw": resample.OP12_SQL,
    "op13_line_dedup": line_dedup.OP13_SQL,
}
