"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quantloom.llm import alignment, collocations, contamination, fingerprints, langid, mixing, nearduplicates, neighbours, packing, pii, substrings, tokens, urls


def queries() -> dict:
    return {
        "op1_near_duplicates": nearduplicates.op1_near_duplicates,
        "op2_language_id": langid.op2_language_id,
        "op3_nearest_neighbours": neighbours.op3_nearest_neighbours,
        "op4_pii_pseudonyms": pii.op4_pii_pseudonyms,
        "op5_order_minhash": fingerprints.op5_order_minhash,
        "op6_source_mixing": mixing.op6_source_mixing,
        "op7_token_counts": tokens.op7_token_counts,
        "op8_substring_dedup": substrings.op8_substring_dedup,
        "op9_packing": packing.op9_packing,
        "op10_url_filters": urls.op10_url_filters,
        "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
        "op12_collocations": collocations.op12_collocations,
        "op13_decontamination": contamination.op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_url_filters": urls.SQL, "op12_collocations": collocations.SQL, "op13_decontamination": contamination.SQL}
