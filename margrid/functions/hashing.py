"""Keyed-hash randomness: uniforms, Gaussian, Laplace and Gumbel draws as column expressions.

A draw depends on the seed and on stable keys only, never on row position, so a retried task
or a second branch of the plan sees the same number.  With ``seed=None`` callers get a fresh
128-bit secret seed, which makes the draws unpredictable; a fixed seed makes them repeatable
and must not be used for a private release.
"""

from __future__ import annotations

import math
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 52
_HEX = _BITS // 4


def fresh_seed(seed: str | int | None) -> str:
    return secrets.token_hex(16) if seed is None else str(seed)


def _text(key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def uniform(seed: str | int, *keys: Column | str) -> Column:
    """Uniform in (0, 1) from md5(seed|key|...)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_text(k) for k in keys]))
    number = F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(float(2**_BITS))


def gaussian(seed: str | int, *keys: Column | str) -> Column:
    """Standard normal by Box-Muller."""
    u1, u2 = uniform(f"{seed}/r", *keys), uniform(f"{seed}/t", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def laplace(seed: str | int, *keys: Column | str) -> Column:
    """Laplace with scale 1."""
    v = uniform(f"{seed}/l", *keys) - F.lit(0.5)
    return -F.signum(v) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(v))


def gumbel(seed: str | int, *keys: Column | str) -> Column:
    """Standard Gumbel: the argmax of score + gumbel samples from softmax(score)."""
    return -F.log(-F.log(uniform(f"{seed}/g", *keys)))
