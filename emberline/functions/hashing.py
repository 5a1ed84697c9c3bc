"""Deterministic uniform draws from row keys.

``hash01(seed, k1, k2, ...) = int(md5("seed:k1:k2...")[0:8], 16) / 2**32``.  A draw depends only on
the seed and the key, never on partitioning or task retries, so splits, folds and synthetic rows
are reproducible after executor loss and identical in Spark and in the SQL oracle. Keys must be
integers or strings (floating-point text differs between engines).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _key_text(seed: str, *keys) -> Column:
    parts = [F.lit(str(seed))]
    for k in keys:
        c = F.col(k) if isinstance(k, str) else k
        parts.append(c.cast("string"))
    return F.concat_ws(":", *parts)


def hash_u32(seed: str, *keys) -> Column:
    """First 32 bits of the md5 of ``seed:key...`` as a bigint in [0, 2**32)."""
    return F.conv(F.substring(F.md5(_key_text(seed, *keys)), 1, 8), 16, 10).cast("bigint")


def hash01(seed: str, *keys) -> Column:
    """Uniform draw in [0, 1) from the key."""
    return hash_u32(seed, *keys).cast("double") / F.lit(TWO_POW_32)


def sql_hash_u32(seed: str, *key_exprs: str) -> str:
    """DuckDB/ANSI twin of :func:`hash_u32` for oracle SQL."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_exprs])
    return f"(('0x' || substr(md5(concat_ws(':', {inner})), 1, 8))::BIGINT)"


def sql_hash01(seed: str, *key_exprs: str) -> str:
    return f"({sql_hash_u32(seed, *key_exprs)} / 4294967296e0)"
