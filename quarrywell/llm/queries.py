"""The queries of this subpackage, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from quarrywell.llm.op1_secrets import op1_secrets
from quarrywell.llm.op2_lexicon_bpe import op2_lexicon_bpe
from quarrywell.llm.op3_warc_zip import op3_warc_zip
from quarrywell.llm.op4_chunk_store import op4_chunk_store
from quarrywell.llm.op5_token_counts import op5_token_counts
from quarrywell.llm.op6_minhash_forest import op6_minhash_forest
from quarrywell.llm.op7_packing import op7_packing
from quarrywell.llm.op8_repeated_units import op8_repeated_units
from quarrywell.llm.op9_quality_rules import op9_quality_rules
from quarrywell.llm.op10_epsilon_grid import op10_epsilon_grid
from quarrywell.llm.op11_filter_audit import SQL as OP11_SQL
from quarrywell.llm.op11_filter_audit import op11_filter_audit
from quarrywell.llm.op12_hard_negatives import SQL as OP12_SQL
from quarrywell.llm.op12_hard_negatives import op12_hard_negatives
from quarrywell.llm.op13_url_rules import SQL as OP13_SQL
from quarrywell.llm.op13_url_rules import op13_url_rules

QUERIES = {
    q.__name__: q
    for q in (op1_secrets, op2_lexicon_bpe, op3_warc_zip, op4_chunk_store, op5_token_counts, op6_minhash_forest, op7_packing, op8_repeated_units, op9_quality_rules, op10_epsilon_grid, op11_filter_audit, op12_hard_negatives, op13_url_rules)
}

#: Tokenizers, archives, signatures and trained models have no SQL form; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op11_filter_audit": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_url_rules": OP13_SQL}
