"""The queries of this subpackage, one for each operator, and SQL for those that SQL can express."""

from loomspan.llm import embedding_dedup, html, langid, line_dedup, lm_scoring, media, mixing, ngram_join, packing, substring_dedup

QUERIES = {
    "op1_media": media.op1_media,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_mixing": mixing.op3_mixing,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_packing": packing.op7_packing,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_language_id": langid.op10_language_id,
}
SQL = {"op3_mixing": mixing.OP3_SQL, "op4_substring_dedup": substring_dedup.OP4_SQL, "op5_embedding_dedup": embedding_dedup.OP5_SQL, "op8_ngram_join": ngram_join.OP8_SQL}
