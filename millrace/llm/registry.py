"""Queries and SQL of this subpackage, for the driver contract."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm import q_crosspolytope, q_katz, q_kneserney, q_mixing, q_orderminhash, q_pii, q_sentencepiece, q_sharding, q_suffixdedup, q_vptree

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_sentencepiece": q_sentencepiece.op1_sentencepiece,
    "op2_mixing": q_mixing.op2_mixing,
    "op3_katz": q_katz.op3_katz,
    "op4_kneserney": q_kneserney.op4_kneserney,
    "op5_crosspolytope": q_crosspolytope.op5_crosspolytope,
    "op6_orderminhash": q_orderminhash.op6_orderminhash,
    "op7_pii": q_pii.op7_pii,
    "op8_vptree": q_vptree.op8_vptree,
    "op9_suffixdedup": q_suffixdedup.op9_suffixdedup,
    "op10_sharding": q_sharding.op10_sharding,
}

ORACLE_SQL = {"op2_mixing": q_mixing.SQL, "op3_katz": q_katz.SQL, "op5_crosspolytope": q_crosspolytope.SQL, "op8_vptree": q_vptree.SQL, "op9_suffixdedup": q_suffixdedup.SQL, "op10_sharding": q_sharding.SQL}

if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
