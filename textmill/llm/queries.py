"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from textmill.llm.centroid_clustering import OP12_SQL, op12_centroid_clustering
from textmill.llm.decontamination import op5_benchmark_decontamination
from textmill.llm.fingerprints import op11_document_fingerprints
from textmill.llm.html_extract import op3_html_extraction
from textmill.llm.mixing import OP7_SQL, op7_mixing
from textmill.llm.ngram_join import OP1_SQL, op1_ngram_jaccard_join
from textmill.llm.pii import OP10_SQL, op10_pii
from textmill.llm.quality import OP6_SQL, op6_quality_rules
from textmill.llm.secrets import OP8_SQL, op8_secret_scans
from textmill.llm.substring_dedup import OP4_SQL, op4_substring_dedup
from textmill.llm.token_counts import op2_token_counts
from textmill.llm.url_filter import OP9_SQL, op9_url_filters
from textmill.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_html_extraction": op3_html_extraction,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_secret_scans": op8_secret_scans,
    "op9_url_filters": op9_url_filters,
    "op10_pii": op10_pii,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_vector_codes": op13_vector_codes,
}
SQL = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op6_quality_rules": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op8_secret_scans": OP8_SQL,
    "op9_url_filters": OP9_SQL,
    "op10_pii": OP10_SQL,
    "op12_centroid_clustering": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
