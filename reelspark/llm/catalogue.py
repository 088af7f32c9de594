"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from .op1_suffix_dedup import op1_suffix_dedup
from .op2_secrets import op2_secret_scan
from .op3_embeddings import ORACLE as OP3_SQL
from .op3_embeddings import op3_embedding_dedup
from .op4_decontaminate import ORACLE as OP4_SQL
from .op4_decontaminate import op4_decontaminate
from .op5_language import op5_language_id
from .op6_minhash import ORACLE as OP6_SQL
from .op6_minhash import op6_minhash_dedup
from .op7_licenses import ORACLE as OP7_SQL
from .op7_licenses import op7_license_scan
from .op8_mix import op8_mix_sources
from .op9_line_dedup import ORACLE as OP9_SQL
from .op9_line_dedup import op9_line_dedup
from .op10_tokens import op10_token_output

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_secret_scan, op3_embedding_dedup, op4_decontaminate, op5_language_id, op6_minhash_dedup, op7_license_scan, op8_mix_sources, op9_line_dedup, op10_token_output)}
ORACLES = {"op3_embedding_dedup": OP3_SQL, "op4_decontaminate": OP4_SQL, "op6_minhash_dedup": OP6_SQL, "op7_license_scan": OP7_SQL, "op9_line_dedup": OP9_SQL}
