"""Queries of this subpackage and the SQL they must agree with."""

from voxelherd.llm import (
    q_bpe, q_chat, q_decontaminate, q_extract, q_language, q_minhash, q_repair, q_sharding, q_simhash, q_substrings,
    q_suffixes, q_variants, q_warc,
)

QUERIES = {
    "op1_suffix_dedup": q_suffixes.op1_suffix_dedup,
    "op2_decontaminate": q_decontaminate.op2_decontaminate,
    "op3_language_id": q_language.op3_language_id,
    "op4_feistel_shards": q_sharding.op4_feistel_shards,
    "op5_bpe_round_trip": q_bpe.op5_bpe_round_trip,
    "op6_minhash": q_minhash.op6_minhash,
    "op7_simhash": q_simhash.op7_simhash,
    "op8_warc_bundles": q_warc.op8_warc_bundles,
    "op9_chat_format": q_chat.op9_chat_format,
    "op10_substring_dedup": q_substrings.op10_substring_dedup,
    "op11_conversation_repair": q_repair.op11_conversation_repair,
    "op12_spelling_variants": q_variants.op12_spelling_variants,
    "op13_html_extraction": q_extract.op13_html_extraction,
}

ORACLES = {
    "op2_decontaminate": q_decontaminate.OP2_SQL,
    "op4_feistel_shards": q_sharding.OP4_SQL,
    "op8_warc_bundles": q_warc.OP8_SQL,
    "op9_chat_format": q_chat.OP9_SQL,
    "op11_conversation_repair": q_repair.OP11_SQL,
    "op12_spelling_variants": q_variants.OP12_SQL,
}
