"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from weftline.llm import html_text, language, media, mixing, pieces, ppm, quality_model, quality_rules, simhash, url_filter


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_mixing": mixing.op3_mixing,
        "op4_media": media.op4_media,
        "op5_html": html_text.op5_html,
        "op6_pieces": pieces.op6_pieces,
        "op7_quality_classifier": quality_model.op7_quality_classifier,
        "op8_lm_scoring": ppm.op8_lm_scoring,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_language_id": language.op10_language_id,
        "url_rules": url_filter.url_rules,
        "media_payloads": media.media_payloads,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.OP2_SQL, "op3_mixing": mixing.OP3_SQL, "url_rules": url_filter.URL_RULES_SQL, "media_payloads": media.MEDIA_PAYLOADS_SQL}
