"""The operators' queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL, run

from .encode import op7_bpe
from .exact import OP2_SQL, op2_exact_dedup
from .langid import op9_language_id
from .licenses import op4_license_scan
from .lines import OP3_SQL, op3_line_dedup
from .media import op5_media
from .packing import op1_best_fit_packing
from .simhash import op6_simhash
from .simple8b import op8_simple8b
from .suffix import op10_suffix_dedup

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_media": op5_media,
    "op6_simhash": op6_simhash,
    "op7_bpe": op7_bpe,
    "op8_simple8b": op8_simple8b,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
    "pipeline": run,
}
ORACLE = {"op2_exact_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL}
if ORACLE_SQL:
    ORACLE["pipeline"] = ORACLE_SQL
