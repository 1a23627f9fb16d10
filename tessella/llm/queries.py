"""The registered queries of the training-data operators."""

from __future__ import annotations

from .decontaminate import OP4_SQL, op4_decontaminate
from .pieces import op10_pieces
from .pii import op9_pii
from .quality import op6_quality
from .simhash import op3_simhash
from .suffix_dedup import OP1_SQL, op1_suffix_dedup
from .token_files import op7_token_files
from .token_windows import OP5_SQL, op5_token_windows
from .toxicity import op2_toxicity
from .urls import OP8_SQL, op8_url_filter

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_windows": op5_token_windows,
    "op6_quality": op6_quality,
    "op7_token_files": op7_token_files,
    "op8_url_filter": op8_url_filter,
    "op9_pii": op9_pii,
    "op10_pieces": op10_pieces,
}
ORACLES = {
    "op1_suffix_dedup": OP1_SQL,
    "op4_decontaminate": OP4_SQL,
    "op5_token_windows": OP5_SQL,
    "op8_url_filter": OP8_SQL,
}
