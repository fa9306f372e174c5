"""The queries of this subpackage and their SQL."""

from . import bpe, chat, decontaminate, divergence, importance, langid, line_dedup, lm, quality, recompression, secrets, simhash, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_chat_format": chat.op2_chat_format,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_recompression": recompression.op5_recompression,
    "op6_simhash": simhash.op6_simhash,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_language_id": langid.op8_language_id,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_lm_score": lm.op10_lm_score,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_importance": importance.op13_importance,
}
ORACLES = {"op2_chat_format": chat.OP2_SQL, "op5_recompression": recompression.OP5_SQL, "op7_secret_scan": secrets.OP7_SQL, "op9_line_dedup": line_dedup.OP9_SQL, "op12_source_divergence": divergence.OP12_SQL, "op13_importance": importance.OP13_SQL}
