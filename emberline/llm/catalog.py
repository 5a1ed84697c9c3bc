"""All training-data queries and their DuckDB twins; importing it registers them."""

from emberline.llm import (bpe, chat_format, decontaminate, exact_dedup, fingerprints, language_id, line_dedup, lm_scoring, mixing,  # noqa: F401
                           near_dedup, spelling, token_counts, va_clusters)
from emberline.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
