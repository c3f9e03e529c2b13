"""The queries of this package, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import licenses, mtree, substring_dedup
from .html_text import op2_html_text
from .language import op9_language_id
from .licenses import op6_license_scan
from .mixing import op8_mixing
from .motion_jpeg import op5_motion_jpeg
from .mtree import op10_mtree_top_k
from .packing import op4_best_fit_packing
from .simhash import op7_simhash
from .substring_dedup import op3_substring_dedup
from .token_files import op1_token_file


def queries() -> dict:
    found = (op1_token_file, op2_html_text, op3_substring_dedup, op4_best_fit_packing, op5_motion_jpeg, op6_license_scan, op7_simhash, op8_mixing, op9_language_id, op10_mtree_top_k)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": substring_dedup.ORACLE, "op6_license_scan": licenses.ORACLE, "op10_mtree_top_k": mtree.ORACLE}
