"""Stateless randomness: every value is a hash of (seed, path, row key), so it does not depend on partitioning or order.

Two streams exist. The fast one is xxhash64, inside whole-stage codegen. The portable one is the first 52 bits of an
MD5, which other engines reproduce exactly. Both give doubles in [0, 1).
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def salt_of(*path: object) -> int:
    """A 63-bit number for a path of names, the same in every process."""
    return int.from_bytes(hashlib.md5("|".join(map(str, path)).encode()).digest()[:8], "big") >> 1


class Rng:
    """Random columns of one entity: ``row`` identifies rows, ``seed`` and ``entity`` the stream."""

    def __init__(self, seed: int, entity: str, row: Column, portable: bool = False):
        self.seed, self.entity, self.row, self.portable = seed, entity, row, portable

    def bits(self, *path: object) -> Column:
        """A non-negative long of 52 (portable) or 53 bits."""
        if self.portable:
            key = F.concat(F.lit("|".join(map(str, (self.seed, self.entity, *path))) + "|"), self.row.cast("string"))
            return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")
        return F.shiftrightunsigned(F.xxhash64(self.row, F.lit(salt_of(self.seed, self.entity, *path))), 11)

    def uniform(self, *path: object) -> Column:
        return self.bits(*path).cast("double") * F.lit(2.0 ** (-52 if self.portable else -53))

    def integer(self, low: int, high: int | Column, *path: object) -> Column:
        """Uniform in [low, high], both included."""
        span = (high if isinstance(high, Column) else F.lit(high)) - low + 1
        return (F.floor(self.uniform(*path) * span) + low).cast("long")

    def normal(self, *path: object) -> Column:
        """Standard normal by Box-Muller; in the fast stream from the two halves of one hash, which reach 6.7 deviations."""
        if self.portable:
            u, a = F.lit(1.0) - self.uniform(*path, "r"), self.uniform(*path, "a")
        else:
            h = F.xxhash64(self.row, F.lit(salt_of(self.seed, self.entity, *path)))
            u, a = (F.shiftrightunsigned(h, 32).cast("double") + 0.5) * 2.0**-32, h.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") * 2.0**-32
        return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * a)

    def pick(self, values: list, *path: object) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), self.integer(1, len(values), *path).cast("int"))

    def weighted(self, values: list, weights: list[float], *path: object) -> Column:
        """A value by weight: the first whose cumulative share exceeds the draw."""
        u, total, at, out = self.uniform(*path), float(sum(weights)), 0.0, None
        if total <= 0:
            return self.pick(values, *path)
        for v, w in zip(values[:-1], weights[:-1], strict=True):
            at += w / total
            out = F.when(u < at, F.lit(v)) if out is None else out.when(u < at, F.lit(v))
        return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


def uniform_sql(seed: int, entity: str, row: str, *path: object) -> str:
    """Rng.uniform of the portable stream as DuckDB SQL."""
    key = "|".join(map(str, (seed, entity, *path))) + "|"
    return f"(cast(('0x' || substr(md5('{key}' || cast({row} as varchar)), 1, 13)) as bigint) * {2.0**-52!r})"


def integer_sql(low: int, high: int | str, seed: int, entity: str, row: str, *path: object) -> str:
    return f"cast(floor({uniform_sql(seed, entity, row, *path)} * ({high} - {low} + 1)) + {low} as bigint)"
