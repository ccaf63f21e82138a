"""Queries of this subpackage, and the SQL for those that SQL can express."""

from gazeloom.llm.byte_bpe import op13_byte_bpe
from gazeloom.llm.chat import op3_chat
from gazeloom.llm.decontamination import op5_decontamination
from gazeloom.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from gazeloom.llm.near_duplicates import op2_near_duplicates
from gazeloom.llm.periodic_runs import op11_periodic_runs
from gazeloom.llm.quality import op1_lm_scoring, op6_quality
from gazeloom.llm.sentencepiece_codec import op10_sentencepiece
from gazeloom.llm.sharding import op9_sharding
from gazeloom.llm.token_files import op4_token_files
from gazeloom.llm.toxicity import op8_toxicity
from gazeloom.llm.topk import OP7_SQL, op7_topk

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_chat": op3_chat,
    "op4_token_files": op4_token_files,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_topk": op7_topk,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL = {"op7_topk": OP7_SQL, "op12_hard_negatives": OP12_SQL}
