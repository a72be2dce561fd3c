"""Seeded pseudo-random columns.

Every draw hashes a row key, never ``rand()``: a lost executor or another partitioning gives the same rows again.
MD5 is used because every SQL engine has it, so a seeded result can be checked outside Spark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hexadecimal digits fit a double exactly, so `unit` is always below 1.
HASH_DIGITS = 13
HASH_SPAN = 16**HASH_DIGITS

Key = Column | str


def _text(key: Key) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def seeded_digest(seed: int, *keys: Key) -> Column:
    """32 hexadecimal digits that depend on the seed and the keys only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_text(k) for k in keys]))


def seeded_hash(seed: int, *keys: Key) -> Column:
    """A bigint in ``[0, HASH_SPAN)`` that depends on the seed and the keys only."""
    return F.conv(F.substring(seeded_digest(seed, *keys), 1, HASH_DIGITS), 16, 10).cast("bigint")


def unit(seed: int, *keys: Key) -> Column:
    """Uniform on ``[0, 1)``."""
    return seeded_hash(seed, *keys) / F.lit(float(HASH_SPAN))


def standard_normal(seed: int, *keys: Key) -> Column:
    """Standard normal by the Box-Muller transform of two uniforms."""
    radius = F.sqrt(-2 * F.log(1 - unit(seed, *keys, F.lit("radius"))))
    return radius * F.cos(2 * math.pi * unit(seed, *keys, F.lit("angle")))
