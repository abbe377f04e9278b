"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from junctura.llm import chat, decontam, dedup, langid, licenses, media, mtree, repair, secret_scan, sp_encode, token_counts, token_store, yinyang

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_sentencepiece": sp_encode.op2_sentencepiece,
    "op3_edit_token_counts": token_counts.op3_edit_token_counts,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_minmax_dedup": dedup.op5_minmax_dedup,
    "op6_cgk_decontamination": decontam.op6_cgk_decontamination,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_chat_format": chat.op8_chat_format,
    "op9_avi_media": media.op9_avi_media,
    "op10_wavelet_tokens": token_store.op10_wavelet_tokens,
    "op11_exact_top_k": mtree.op11_exact_top_k,
    "op12_yinyang_clusters": yinyang.op12_yinyang_clusters,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

ORACLES = {
    "op5_minmax_dedup": dedup.ORACLE,
    "op8_chat_format": chat.ORACLE,
    "op11_exact_top_k": mtree.ORACLE,
    "op12_yinyang_clusters": yinyang.ORACLE,
    "op13_conversation_repair": repair.ORACLE,
}
