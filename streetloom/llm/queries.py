"""The registered query of each operator, with production parameters, and SQL where SQL can express it."""

from . import bpe, chat, cotraining, decontam, exact_dedup, langid, line_dedup, simhash, token_counts, toxicity

QUERIES = {
    "op1_cotraining": cotraining.query,
    "op2_toxicity": toxicity.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_language_id": langid.query,
    "op5_decontamination": decontam.query,
    "op6_line_dedup": line_dedup.query,
    "op7_bpe": bpe.query,
    "op8_chat": chat.query,
    "op9_simhash": simhash.query,
    "op10_token_counts": token_counts.query,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op5_decontamination": decontam.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op8_chat": chat.ORACLE,
}
