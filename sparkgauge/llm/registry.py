"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audit, centroids, chat, decontam, extraction, linededup, mixing, neardup, pieces, quality, toxicity, urlfilter, warc

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_quality": quality.op2,
    "op3_toxicity": toxicity.op3,
    "op4_extraction": extraction.op4,
    "op5_urlfilter": urlfilter.op5,
    "op6_decontam": decontam.op6,
    "op7_neardup": neardup.op7,
    "op8_chat": chat.op8,
    "chat_calls": chat.chat_calls,
    "op9_linededup": linededup.op9,
    "op10_warc": warc.op10,
    "op11_centroids": centroids.op11,
    "op12_audit": audit.op12,
    "op13_pieces": pieces.op13,
}
ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_quality": quality.OP2_SQL,
    "op5_urlfilter": urlfilter.OP5_SQL,
    "op6_decontam": decontam.OP6_SQL,
    "op7_neardup": neardup.OP7_SQL,
    "op8_chat": chat.OP8_SQL,
    "chat_calls": chat.CHAT_CALLS_SQL,
    "op9_linededup": linededup.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_centroids": centroids.OP11_SQL,
    "op12_audit": audit.OP12_SQL,
}
