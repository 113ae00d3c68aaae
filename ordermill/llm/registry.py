"""Queries of this package and their DuckDB equivalents."""

from __future__ import annotations

from . import (chat, jaccard, langid, licences, mixing, neardup, packing, pii, tokenfile, topk, warc, whitening,
               wordruns)


def queries():
    return {
        "op1_language_id": langid.op1_language_id,
        "op1_pages_language": langid.pages_language,
        "op2_jaccard_join": jaccard.op2_jaccard_join,
        "op3_mixing": mixing.op3_mixing,
        "op4_embedding_neardup": neardup.op4_embedding_neardup,
        "op5_token_files": tokenfile.op5_token_files,
        "op6_topk_search": topk.op6_topk_search,
        "op7_warc": warc.op7_warc,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_pii": pii.op9_pii,
        "op10_license_scan": licences.op10_license_scan,
        "op11_word_runs": wordruns.op11_word_runs,
        "op12_chat_formatting": chat.op12_chat_formatting,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql():
    return {"op2_jaccard_join": jaccard.ORACLE_SQL, "op3_mixing": mixing.ORACLE_SQL, "op4_embedding_neardup": neardup.ORACLE_SQL,
            "op6_topk_search": topk.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL, "op12_chat_formatting": chat.ORACLE_SQL}
