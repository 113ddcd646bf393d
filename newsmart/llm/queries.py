"""The operators over their whole tables, and the same results in SQL where SQL can state them."""

from __future__ import annotations

import corpus_pipeline
from newsmart.llm.embeddings import OP10_SQL, op10_embedding_neardup
from newsmart.llm.lines import OP6_SQL, op6_line_dedup
from newsmart.llm.lm import op1_lm_scoring
from newsmart.llm.minhash import op7_minhash
from newsmart.llm.mixing import op8_mixing
from newsmart.llm.packing import op5_packing
from newsmart.llm.periods import OP11_SQL, op11_periodic_runs
from newsmart.llm.pii import op9_pii
from newsmart.llm.simhash import op2_simhash
from newsmart.llm.substrings import OP3_SQL, op3_substring_dedup
from newsmart.llm.tokens import op12_token_store
from newsmart.llm.toxicity import op4_toxicity
from newsmart.llm.turns import OP13_SQL, op13_conversation_repair

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_simhash": op2_simhash,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_minhash": op7_minhash,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_embedding_neardup": op10_embedding_neardup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_store": op12_token_store,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op3_substring_dedup": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op10_embedding_neardup": OP10_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op13_conversation_repair": OP13_SQL,
}
