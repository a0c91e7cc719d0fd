"""Query keys of this subpackage and, where SQL can express one, its DuckDB statement."""

from __future__ import annotations

from offerlake.llm import op2_forest as forest
from offerlake.llm import op5_minhash as minhash
from offerlake.llm import op11_collocation as collocation
from offerlake.llm import op12_prefix_trie as prefix_trie
from offerlake.llm.op1_toxicity import op1_toxicity
from offerlake.llm.op2_forest import op2_forest
from offerlake.llm.op3_packing import op3_packing
from offerlake.llm.op4_sharding import op4_sharding
from offerlake.llm.op5_minhash import op5_minhash
from offerlake.llm.op6_suffix_dedup import op6_suffix_dedup
from offerlake.llm.op7_lattice import op7_lattice
from offerlake.llm.op8_language import op8_language
from offerlake.llm.op9_bpe import op9_bpe
from offerlake.llm.op10_fingerprint import op10_fingerprint
from offerlake.llm.op11_collocation import op11_collocation
from offerlake.llm.op12_prefix_trie import op12_prefix_trie
from offerlake.llm.op13_disclosure import op13_disclosure

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_forest, op3_packing, op4_sharding, op5_minhash, op6_suffix_dedup,
                                   op7_lattice, op8_language, op9_bpe, op10_fingerprint, op11_collocation, op12_prefix_trie, op13_disclosure)}
ORACLE: dict[str, str] = {"op2_forest": forest.ORACLE, "op5_minhash": minhash.ORACLE, "op11_collocation": collocation.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE}
