"""The registered queries of this package and the SQL that they are compared with."""

from . import fingerprints, html, language, licenses, minhash, mixing, negatives, pieces, pii, quality, scoring, warc, whitening


def queries():
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_language_id": language.op2_language_id,
        "op3_warc": warc.op3_warc,
        "op4_near_duplicates": minhash.op4_near_duplicates,
        "op5_pseudonyms": pii.op5_pseudonyms,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_lm_scores": scoring.op7_lm_scores,
        "op8_fingerprints": fingerprints.op8_fingerprints,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_sentencepiece": pieces.op10_sentencepiece,
        "op11_whitening": whitening.op11_whitening,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_main_text": html.op13_main_text,
    }


def oracle_sql():
    return {
        "op1_quality_rules": quality.ORACLE,
        "op8_fingerprints": fingerprints.ORACLE,
        "op9_mix_sources": mixing.ORACLE,
        "op12_hard_negatives": negatives.ORACLE,
    }
