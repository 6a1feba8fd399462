"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .bpe import op9_byte_bpe
from .importance import op13_importance
from .langid import op12_language
from .licenses import op7_licenses
from .media import op1_media_columns
from .mixing import op8_mixing
from .pii import op2_pii
from .runs import op11_runs
from .simhash import op6_simhash
from .substrings import OP3_SQL, op3_substrings
from .suffixes import OP5_SQL, op5_suffixes
from .topk import OP4_SQL, op4_topk
from .toxicity import op10_toxicity

QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_pii": op2_pii,
    "op3_substrings": op3_substrings,
    "op4_topk": op4_topk,
    "op5_suffixes": op5_suffixes,
    "op6_simhash": op6_simhash,
    "op7_licenses": op7_licenses,
    "op8_mixing": op8_mixing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_runs": op11_runs,
    "op12_language": op12_language,
    "op13_importance": op13_importance,
}

SQL: dict[str, str] = {"op3_substrings": OP3_SQL, "op4_topk": OP4_SQL, "op5_suffixes": OP5_SQL}
