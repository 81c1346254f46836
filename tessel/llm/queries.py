"""The registered queries of this subpackage and their SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from .langid import op9_language_id
from .lines import OP2_SQL, op2_line_dedup
from .media import op1_media_columns
from .mixing import OP7_SQL, op7_mixing
from .outliers import op4_quality_rules
from .pieces import op5_sentencepiece
from .repeats import op6_suffix_dedup
from .secrets import op3_secret_scans
from .simhash import op8_simhash_near_dedup
from .token_files import op10_token_files

QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scans": op3_secret_scans,
    "op4_quality_rules": op4_quality_rules,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_token_files": op10_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op7_mixing": OP7_SQL,
}
