"""The corpus queries and the SQL they must equal, where SQL can express them."""

from __future__ import annotations

from tablewright.llm import blob_ledger, content_sort, curriculum, jaccard, lattice, packing, prefix_trie, quality, recompression, tag_paths, toxicity, url_cascade, wu_manber

QUERIES = {
    "op1_lattice": lattice.op1_lattice,
    "op2_curriculum": curriculum.op2_curriculum,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality": quality.op4_quality,
    "op5_content_sort": content_sort.op5_content_sort,
    "op6_tag_paths": tag_paths.op6_tag_paths,
    "op7_url_cascade": url_cascade.op7_url_cascade,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_blob_ledger": blob_ledger.op9_blob_ledger,
    "op10_packing": packing.op10_packing,
    "op11_recompression": recompression.op11_recompression,
    "op12_wu_manber": wu_manber.op12_wu_manber,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op1_lattice": lattice.OP1_SQL,
    "op2_curriculum": curriculum.OP2_SQL,
    "op5_content_sort": content_sort.OP5_SQL,
    "op7_url_cascade": url_cascade.OP7_SQL,
    "op8_jaccard": jaccard.OP8_SQL,
    "op9_blob_ledger": blob_ledger.OP9_SQL,
    "op11_recompression": recompression.OP11_SQL,
    "op12_wu_manber": wu_manber.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
