"""Signed logarithmic buckets of fixed relative width, as plain column expressions.

With relative error a, gamma = (1+a)/(1-a). A value x > 0 falls in bucket ceil(log_gamma x), every value of which lies
within a (relative) of the bucket's centre 2*gamma^i/(gamma+1). Negative values mirror that. Keys order as values do:
positive values get i + OFFSET, negative ones -(i + OFFSET), zero 0. Doubles span less than 2*OFFSET keys for any a >= 0.001.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = 1_000_000


def gamma(relative_error: float) -> float:
    if not 0.001 <= relative_error < 1:
        raise ValueError("the relative error must be at least 0.001 and less than 1")
    return (1 + relative_error) / (1 - relative_error)


def bucket_of(x: Column, relative_error: float) -> Column:
    """Bucket key (long) of a numeric column; null for null and NaN. Infinite values share the outermost finite bucket."""
    x = x.cast("double")
    top = F.lit(1.7976931348623157e308)
    size = F.least(F.abs(x), top)
    i = F.ceil(F.ln(size) / F.lit(math.log(gamma(relative_error)))).cast("long") + OFFSET
    return F.when(F.isnan(x), None).when(x > 0, i).when(x < 0, -i).when(x == 0, F.lit(0).cast("long"))


def value_of(key: Column, relative_error: float) -> Column:
    """The centre of a bucket."""
    g = gamma(relative_error)
    # from the bucket's lower end, so that the last bucket stays finite
    size = F.least(F.lit(1.7976931348623157e308), F.pow(F.lit(g), F.abs(key).cast("double") - (OFFSET + 1)) * F.lit(2 * g / (g + 1)))
    return F.when(key == 0, F.lit(0.0)).when(key > 0, size).when(key < 0, -size)


def bucket_sql(x: str, relative_error: float) -> str:
    """bucket_of as ANSI SQL."""
    i = f"(cast(ceil(ln(least(abs(x_), 1.7976931348623157e308)) / {math.log(gamma(relative_error))!r}) as bigint) + {OFFSET})".replace("x_", f"cast({x} as double)")
    return f"(case when {x} is null or isnan(cast({x} as double)) then null when {x} > 0 then {i} when {x} < 0 then -{i} else 0 end)"


def value_sql(key: str, relative_error: float) -> str:
    g = gamma(relative_error)
    size = f"(pow(cast({g!r} as double), abs({key}) - {OFFSET + 1}) * cast({2 * g / (g + 1)!r} as double))"
    return f"(case when {key} = 0 then 0.0 when {key} > 0 then {size} else -{size} end)"
