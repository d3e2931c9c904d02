"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from vecloom.llm import exact_dedup, html_text, language, minhash, mixing, packing, pivot_search, secret_scan, substring_dedup, warc


def queries() -> dict:
    return {
        "op1_html_extraction": html_text.op1_html_extraction,
        "op2_minhash": minhash.op2_minhash,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_mixing": mixing.op5_mixing,
        "op6_warc": warc.op6_warc,
        "op7_packing": packing.op7_packing,
        "op8_pivot_search": pivot_search.op8_pivot_search,
        "op9_language_id": language.op9_language_id,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict:
    return {"op2_minhash": minhash.ORACLE_SQL, "op6_warc": warc.ORACLE_SQL, "op10_exact_dedup": exact_dedup.ORACLE_SQL}
