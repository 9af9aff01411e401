"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from cellweave.llm import audit, bpe, chat, jaccard, lexical, lines, mixing, packing, quality, sharding, tokens, topk, warc

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_token_file": packing.op2_token_file,
    "op3_quality": quality.op3_quality,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_mixing": mixing.op5_mixing,
    "op6_topk": topk.op6_topk,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_warc": warc.op8_warc,
    "op9_sharding": sharding.op9_sharding,
    "op10_bpe_chunks": bpe.op10_bpe_chunks,
    "op11_chat_format": chat.op11_chat_format,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_filter_audit": audit.op13_filter_audit,
}

ORACLE_SQL = {"op4_ngram_jaccard": jaccard.ORACLE_OP4, "op6_topk": topk.ORACLE_OP6, "op7_line_dedup": lines.ORACLE_OP7, "op8_warc": warc.ORACLE_OP8, "op11_chat_format": chat.ORACLE_OP11, "op12_lexical_search": lexical.ORACLE_OP12, "op13_filter_audit": audit.ORACLE_OP13}
