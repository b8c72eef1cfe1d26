"""Queries of this subpackage and their SQL, by name."""

from quarrystone.llm import decontaminate, exact_dedup, fill_in_middle, language, licenses, line_quality, near_dups, packing, pii, secrets, spelling, urls, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_pii": pii.op2_pii,
    "op3_language": language.op3_language,
    "op4_secrets": secrets.op4_secrets,
    "op5_url_filter": urls.op5_url_filter,
    "op6_jaccard_join": near_dups.op6_jaccard_join,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_licenses": licenses.op8_licenses,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_warc": warc.op10_warc,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_spelling_groups": spelling.op12_spelling_groups,
    "op13_line_quality": line_quality.op13_line_quality,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_url_filter": urls.ORACLE_SQL,
    "op6_jaccard_join": near_dups.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "op11_fill_in_middle": fill_in_middle.ORACLE_SQL,
    "op12_spelling_groups": spelling.ORACLE_SQL,
}
