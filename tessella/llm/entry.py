"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from tessella.llm import decontaminate, fingerprints, html_text, jaccard, lexical, line_dedup, mixing, periodic_runs, pseudonyms, quality, sentencepieces, sharding, token_files


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_jaccard_join": jaccard.op2_jaccard_join,
        "op3_quality": quality.op3_quality,
        "op4_html_text": html_text.op4_html_text,
        "op5_sharding": sharding.op5_sharding,
        "op6_pseudonyms": pseudonyms.op6_pseudonyms,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_token_counts": token_files.op8_token_counts,
        "op9_sentencepieces": sentencepieces.op9_sentencepieces,
        "op10_decontamination": decontaminate.op10_decontamination,
        "op11_lexical_search": lexical.op11_lexical_search,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_mixing": mixing.op13_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op10_decontamination": decontaminate.SQL, "op11_lexical_search": lexical.SQL, "op13_mixing": mixing.SQL}
