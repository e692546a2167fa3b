"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from gridlogic.llm import chatformat, decontaminate, langid, linededup, media, mixing, secrets, simhash, spelling, tokenshards, toxicity, warc, whitening

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_warc": warc.query,
    "op3_decontaminate": decontaminate.query,
    "op4_simhash": simhash.query,
    "op5_chat_format": chatformat.query,
    "op6_media_columns": media.query,
    "op7_language_id": langid.query,
    "op8_secret_scan": secrets.query,
    "op9_token_shards": tokenshards.query,
    "op10_line_dedup": linededup.query,
    "op11_whitening": whitening.query,
    "op12_spelling": spelling.query,
    "op13_toxicity": toxicity.query,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE_SQL,
    "op2_warc": warc.ORACLE_SQL,
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op5_chat_format": chatformat.ORACLE_SQL,
    "op10_line_dedup": linededup.ORACLE_SQL,
    "op12_spelling": spelling.ORACLE_SQL,
}
