"""The queries of this package, gathered."""

from . import bpe, exact_dedup, language_id, line_dedup, near_dedup, nearest, packing, quality, secret_scan, token_files

MODULES = (packing, quality, near_dedup, line_dedup, token_files, bpe, secret_scan, language_id, nearest, exact_dedup)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
