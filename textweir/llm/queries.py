"""Registered queries of the training-data operators, and their SQL."""

from textweir.llm.decontaminate import op6_decontamination
from textweir.llm.line_dedup import OP4_SQL, op4_line_dedup
from textweir.llm.lm_scoring import op1_lm_scoring
from textweir.llm.packing import op5_packing
from textweir.llm.quality_rules import OP3_SQL, op3_quality_rules
from textweir.llm.simhash import op7_simhash
from textweir.llm.suffix_dedup import op10_suffix_dedup
from textweir.llm.token_counts import op2_token_counts
from textweir.llm.token_output import op8_token_output
from textweir.llm.url_filters import OP9_SQL, op9_url_filters

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_token_output": op8_token_output,
    "op9_url_filters": op9_url_filters,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLES = {
    "op3_quality_rules": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op9_url_filters": OP9_SQL,
}
