"""The subpackage's queries by name, and DuckDB SQL where it can express one."""
from harborline.llm import (  # noqa: F401  each registers its query
    best_fit_packing,
    embedding_whitening,
    jaccard_join,
    katz_model,
    length_histogram,
    piece_tokens,
    quality_classifier,
    quality_rules,
    secret_scans,
    substring_dedup,
    template_decontamination,
    token_files,
    vector_codes,
)
from harborline.llm.registry import ORACLE, QUERIES  # noqa: F401
