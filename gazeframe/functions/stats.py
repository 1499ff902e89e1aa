"""Statistics as columns: normal tail, rank tests from sums, multiple testing helpers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Panels of the Simpson sum; the error of the tail is below 1e-10.
PANELS = 400


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of the standard normal, by a Simpson sum over its density (capped at 9, beyond which it is 0)."""
    a = F.least(F.abs(z), F.lit(9.0))
    step = a / PANELS
    terms = F.transform(F.sequence(F.lit(0), F.lit(PANELS)), lambda i: F.when((i == 0) | (i == PANELS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) * F.exp(-(i * step) * (i * step) / 2))
    area = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) * step / 3 * 0.3989422804014327
    return F.greatest(F.lit(0.0), F.lit(1.0) - area * 2)


@F.pandas_udf(DoubleType())
def exact_rank_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Two-sided exact p of a Mann-Whitney U without ties; used for small samples only."""

    def counts(a: int, b: int) -> list[int]:
        # Ways to reach each U: item j of the larger sample adds 0..a, as the product of Gaussian polynomials.
        ways = [1] + [0] * (a * b)
        for i in range(1, a + 1):
            for k in range(a * b, b + i - 1, -1):
                ways[k] -= ways[k - b - i]
            for k in range(i, a * b + 1):
                ways[k] += ways[k - i]
        return ways

    cache: dict = {}
    out = []
    for x, a, b in zip(u, n1, n2, strict=True):
        if x is None or x != x or a != a or b != b or min(a, b) < 1 or min(a, b) > 8:
            out.append(None)
            continue
        a, b = int(a), int(b)
        ways = cache.setdefault((a, b), counts(a, b))
        big = max(x, a * b - x)
        upper = sum(ways[int(-(-big // 1)) :]) / sum(ways)
        out.append(min(1.0, 2 * upper))
    return pd.Series(out, dtype="float64")


def rank_test_p(u1: Column, n1: Column, n2: Column, tie_sum: Column) -> Column:
    """Two-sided p: exact for a sample of at most 8 without ties, else normal with tie and continuity corrections."""
    n = (n1 + n2).cast("double")
    mean = n1 * n2 / F.lit(2.0)
    var = n1 * n2 / F.lit(12.0) * ((n + 1) - tie_sum / (n * (n - 1)))
    z = (F.greatest(u1, n1 * n2 - u1) - mean - 0.5) / F.sqrt(var)
    normal = F.when(var > 0, F.when(z <= 0, 1.0).otherwise(normal_two_sided(z))).otherwise(F.lit(1.0))
    small = (F.least(n1, n2) <= 8) & (tie_sum == 0)
    return F.when((n1 < 2) | (n2 < 2), F.lit(None)).when(small, exact_rank_p(u1.cast("double"), n1.cast("double"), n2.cast("double"))).otherwise(normal)
