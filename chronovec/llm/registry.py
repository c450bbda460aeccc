"""Queries of this subpackage and their SQL."""

from . import alignment, bpe, chat, decontaminate, exact_dedup, html_text, line_rules, near_dedup, quality, resampling, sharding, toxicity, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_quality": quality.op4_quality,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_rendezvous_sharding": sharding.op6_rendezvous_sharding,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op8_warc": warc.op8_warc,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_html_text": html_text.op10_html_text,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_line_quality": line_rules.op13_line_quality,
}
SQL = {
    "op3_chat_formatting": chat.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op6_rendezvous_sharding": sharding.SQL,
    "op7_minhash_near_dedup": near_dedup.SQL,
    "op8_warc": warc.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_importance_resampling": resampling.SQL,
    "op13_line_quality": line_rules.SQL,
}
