"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import anisotropic, hnsw, linededup, mixing, neardup, packing, pii, prefixtrie, secrets, sortmeans, suffix_tree, toxicity, urls

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_suffix_tree": suffix_tree.op2_suffix_tree,
    "op3_surrogates": pii.op3_surrogates,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_vector_near_duplicates": hnsw.op5_vector_near_duplicates,
    "op6_inner_product_search": anisotropic.op6_inner_product_search,
    "op7_url_filters": urls.op7_url_filters,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_near_duplicates": neardup.op10_near_duplicates,
    "op11_line_dedup": linededup.op11_line_dedup,
    "op12_prefix_trie": prefixtrie.op12_prefix_trie,
    "op13_sort_means": sortmeans.op13_sort_means,
}
ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op7_url_filters": urls.OP7_SQL,
    "op8_secret_scans": secrets.OP8_SQL,
    "op11_line_dedup": linededup.OP11_SQL,
    "op12_prefix_trie": prefixtrie.OP12_SQL,
    "op13_sort_means": sortmeans.OP13_SQL,
}
