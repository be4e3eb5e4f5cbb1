"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import decontamination, substrings
from .decontamination import op10_decontamination
from .orderminhash import op7_order_minhash
from .packing import op9_packing
from .quality import op4_quality
from .sharding import op2_sharding
from .simhash import op1_simhash
from .substrings import op6_substrings
from .tokencounts import op8_token_counts
from .tokenfiles import op3_token_files
from .toxicity import op5_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sharding": op2_sharding,
    "op3_token_files": op3_token_files,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_substrings": op6_substrings,
    "op7_order_minhash": op7_order_minhash,
    "op8_token_counts": op8_token_counts,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
}

ORACLES = {
    "op6_substrings": substrings.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
}
