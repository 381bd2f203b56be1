"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from .block_dedup import OP6_SQL, op6_block_dedup
from .cotraining import op4_cotraining
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .fingerprints import op7_fingerprints
from .minhash import OP3_SQL, op3_minhash
from .mixing import OP9_SQL, op9_mixing
from .sampling import op1_sampling
from .secrets import op5_secrets
from .suffix_dedup import OP2_SQL, op2_suffix_dedup
from .token_counts import op8_token_counts

QUERIES = {
    "op1_sampling": op1_sampling,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_minhash": op3_minhash,
    "op4_cotraining": op4_cotraining,
    "op5_secrets": op5_secrets,
    "op6_block_dedup": op6_block_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
}

SQL = {
    "op2_suffix_dedup": OP2_SQL,
    "op3_minhash": OP3_SQL,
    "op6_block_dedup": OP6_SQL,
    "op9_mixing": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
}
