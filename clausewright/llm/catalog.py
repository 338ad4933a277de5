"""The numbered operators' queries, and their SQL twins where SQL can express them."""

from __future__ import annotations

from clausewright.llm.decontamination import OP2_SQL, op2_positional_index
from clausewright.llm.fill_in_middle import OP12_SQL, op12_boundary_index
from clausewright.llm.licenses import op9_conditional_licenses
from clausewright.llm.mixing import OP11_SQL, op11_exponential_mix
from clausewright.llm.packing import op8_best_fit_packing
from clausewright.llm.quality import op1_fourier_quality
from clausewright.llm.ranked_search import OP13_SQL, op13_threshold_search
from clausewright.llm.sharding import op3_virtual_slots
from clausewright.llm.simhash import op5_covering_simhash
from clausewright.llm.substrings import op7_doubling_substrings
from clausewright.llm.token_counts import op10_token_counts
from clausewright.llm.toxicity import op6_recurrent_toxicity
from clausewright.llm.vantage import op4_vantage_trees

QUERIES = {
    "op1_fourier_quality": op1_fourier_quality,
    "op2_positional_index": op2_positional_index,
    "op3_virtual_slots": op3_virtual_slots,
    "op4_vantage_trees": op4_vantage_trees,
    "op5_covering_simhash": op5_covering_simhash,
    "op6_recurrent_toxicity": op6_recurrent_toxicity,
    "op7_doubling_substrings": op7_doubling_substrings,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_conditional_licenses": op9_conditional_licenses,
    "op10_token_counts": op10_token_counts,
    "op11_exponential_mix": op11_exponential_mix,
    "op12_boundary_index": op12_boundary_index,
    "op13_threshold_search": op13_threshold_search,
}

ORACLE: dict[str, str] = {
    "op2_positional_index": OP2_SQL,
    "op11_exponential_mix": OP11_SQL,
    "op12_boundary_index": OP12_SQL,
    "op13_threshold_search": OP13_SQL,
}
