"""The registered queries of the llm operators and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

from hirelake.llm import (alignment, chat, decontaminate, fingerprints, linededup, merkle, mixing, pii, quality,
                          secrets, sharding, simhash, tokencount)

QUERIES = {
    "op1_pii": pii.op1,
    "op2_line_dedup": linededup.op2,
    "op3_quality": quality.op3,
    "op4_secrets": secrets.op4,
    "op5_fingerprints": fingerprints.op5,
    "op6_decontaminate": decontaminate.op6,
    "op7_simhash": simhash.op7,
    "op8_chat_preferences": chat.op8,
    "op9_sharding": sharding.op9,
    "op10_mixing": mixing.op10,
    "op11_alignment": alignment.op11,
    "op12_merkle": merkle.op12,
    "op13_token_counts": tokencount.op13,
}

ORACLES = {
    "op2_line_dedup": linededup.OP2_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op8_chat_preferences": chat.OP8_SQL,
    "op12_merkle": merkle.OP12_SQL,
}
