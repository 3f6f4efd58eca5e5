"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, divergence, filters, flac, langid, minhash, mixing, pii, repeats, secrets, sharding


def queries():
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_secrets": secrets.op2_secrets,
        "op3_pii": pii.op3_pii,
        "op4_mixing": mixing.op4_mixing,
        "op5_chat": chat.op5_chat,
        "op6_repeats": repeats.op6_repeats,
        "op7_near_duplicates": minhash.op7_near_duplicates,
        "op8_language": langid.op8_language,
        "op9_media": flac.op9_media,
        "op10_sharding": sharding.op10_sharding,
        "op11_bpe": bpe.op11_bpe,
        "op12_filter_audit": filters.op12_filter_audit,
        "op13_source_divergence": divergence.op13_source_divergence,
    }


def oracle_sql():
    return {"op1_decontamination": decontaminate.OP1_SQL, "op5_chat": chat.OP5_SQL, "op7_near_duplicates": minhash.OP7_SQL, "op12_filter_audit": filters.OP12_SQL, "op13_source_divergence": divergence.OP13_SQL}
