"""Reproducible draws by integer arithmetic, the same in any SQL engine.

A draw is a function of an id and a salt, so it doesn't depend on partitions or order, and each column
of a generated table has a salt of its own instead of a place in one shared random stream.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2_147_483_647


def draw_sql(id_sql: str, salt: int) -> str:
    """SQL for a number in [0, MODULUS); ids and salts of any size, without overflow in 64 bits."""
    line = f"((({id_sql}) % 2147483648 * 1103515245 + 12345 + {salt % 100_003} * 40503) % 2147483648)"
    return f"(({line} * {line} + {line} * 48271) % {MODULUS})"


def uniform_sql(id_sql: str, salt: int, n_sql: str) -> str:
    """SQL for a number in [0, n)."""
    return f"({draw_sql(id_sql, salt)} % ({n_sql}))"


def draw(id_sql: str, salt: int) -> Column:
    return F.expr(draw_sql(id_sql, salt))


def drawn(ids: np.ndarray, salt: int) -> np.ndarray:
    """The same numbers for an array of 64-bit ids."""
    line = np.fmod(np.fmod(ids, 1 << 31) * 1103515245 + 12345 + salt % 100_003 * 40503, 1 << 31)
    return np.fmod(line * line + line * 48271, MODULUS)
