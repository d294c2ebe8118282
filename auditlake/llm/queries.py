"""The registered queries of this subpackage and their SQL, where SQL can state the result."""

from auditlake.llm.automaton import op9_merge_automaton
from auditlake.llm.embedding_dups import op5_inverted_multi_index
from auditlake.llm.html_blocks import OP13_SQL, op13_block_labeller
from auditlake.llm.lexical_search import OP12_SQL, op12_range_maximum_search
from auditlake.llm.near_dups import op8_min_max_hashing
from auditlake.llm.neighbours import op1_collision_counting
from auditlake.llm.packing import op4_pattern_packing
from auditlake.llm.private_data import op6_bootstrapped_private_data
from auditlake.llm.repeats import op10_suffix_repeats
from auditlake.llm.runs import OP11_SQL, op11_recursive_splitting
from auditlake.llm.token_store import op3_token_store
from auditlake.llm.toxicity import op7_compression_distance
from auditlake.llm.url_rules import OP2_SQL, op2_range_join_rules

QUERIES = {
    "op1_collision_counting": op1_collision_counting,
    "op2_range_join_rules": op2_range_join_rules,
    "op3_token_store": op3_token_store,
    "op4_pattern_packing": op4_pattern_packing,
    "op5_inverted_multi_index": op5_inverted_multi_index,
    "op6_bootstrapped_private_data": op6_bootstrapped_private_data,
    "op7_compression_distance": op7_compression_distance,
    "op8_min_max_hashing": op8_min_max_hashing,
    "op9_merge_automaton": op9_merge_automaton,
    "op10_suffix_repeats": op10_suffix_repeats,
    "op11_recursive_splitting": op11_recursive_splitting,
    "op12_range_maximum_search": op12_range_maximum_search,
    "op13_block_labeller": op13_block_labeller,
}

STATEMENTS: dict[str, str] = {
    "op2_range_join_rules": OP2_SQL,
    "op11_recursive_splitting": OP11_SQL,
    "op12_range_maximum_search": OP12_SQL,
    "op13_block_labeller": OP13_SQL,
}
