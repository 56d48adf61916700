"""The queries of this subpackage and their DuckDB equivalents."""

from . import audio, chat, line_templates, mixing, near_duplicates, packing, personal_data, quality_rules, token_files, warc

QUERIES = {
    "op2_near_duplicates": near_duplicates.query,
    "op1_personal_data": personal_data.query,
    "op3_warc": warc.query,
    "op4_quality_rules": quality_rules.query,
    "op5_mixing": mixing.query,
    "op6_token_files": token_files.query,
    "op7_audio": audio.query,
    "op8_line_templates": line_templates.query,
    "op9_packing": packing.query,
    "op10_chat": chat.query,
}

SQL = {
    "op3_warc": warc.SQL,
    "op5_mixing": mixing.SQL,
}
