"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .clustering import OP11_SQL, op11_centroid_clustering
from .codes import OP13_SQL, op13_vector_codes
from .decontamination import OP1_SQL, op1_decontamination
from .embeddings import op6_embedding_dedup
from .language import op5_language
from .packing import op7_packing
from .pii import op9_pii
from .quality import op2_quality
from .sharding import op3_sharding
from .simhash import op4_simhash
from .substrings import OP12_SQL, op12_substring_dedup
from .token_files import op8_token_files
from .toxicity import op10_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_language": op5_language,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_packing": op7_packing,
    "op8_token_files": op8_token_files,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_substring_dedup": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
