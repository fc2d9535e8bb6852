"""Queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from . import byte_bpe, chat_format, classifier, filter_audit, mixing, near_dedup, pair_index, quality_rules, spot_signatures, token_records, url_filter, vector_codes, warc


def queries() -> dict:
    """Each takes (spark, sf_dir) and covers its whole table."""
    return {
        "op1_warc": warc.op1_warc,
        "op2_spot_signatures": spot_signatures.op2_spot_signatures,
        "op3_quality_classifier": classifier.op3_quality_classifier,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_byte_bpe": byte_bpe.op5_byte_bpe,
        "op6_token_records": token_records.op6_token_records,
        "op7_mixing": mixing.op7_mixing,
        "op8_order_minhash": near_dedup.op8_order_minhash,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_pair_index_bpe": pair_index.op13_pair_index_bpe,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL expresses the whole result."""
    return {
        "op1_warc": warc.OP1_SQL,
        "op4_chat_format": chat_format.OP4_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op10_url_filter": url_filter.OP10_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op12_vector_codes": vector_codes.OP12_SQL,
    }
