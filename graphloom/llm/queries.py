"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontaminate import SQL as OP4_SQL
from .decontaminate import op4_decontamination
from .filter_audit import SQL as OP12_SQL
from .filter_audit import op12_filter_audit
from .html_text import op6_html_extraction
from .line_dedup import SQL as OP8_SQL
from .line_dedup import op8_line_dedup
from .media import op1_media_columns
from .near_dup import op3_minhash_near_dedup
from .pack import op7_best_fit_packing
from .personal import op11_personal_data
from .quality import op9_quality_classifier
from .ranked_search import SQL as OP13_SQL
from .ranked_search import op13_ranked_search
from .secrets import op2_secret_scans
from .token_count import op10_token_counts
from .url_filter import SQL as OP5_SQL
from .url_filter import op5_url_filter

QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_secret_scans": op2_secret_scans,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_html_extraction": op6_html_extraction,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_counts": op10_token_counts,
    "op11_personal_data": op11_personal_data,
    "op12_filter_audit": op12_filter_audit,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL = {"op4_decontamination": OP4_SQL, "op5_url_filter": OP5_SQL, "op8_line_dedup": OP8_SQL, "op12_filter_audit": OP12_SQL, "op13_ranked_search": OP13_SQL}
