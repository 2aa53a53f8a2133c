"""Confidence of a connection, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schema import CROSS_KEY, DEFAULT_WEIGHT, WEIGHTS


def weight_for(key: Column) -> Column:
    """A field's or tag's weight; case and outer blanks don't matter."""
    out = None
    for value in sorted(set(WEIGHTS.values())):
        names = [k for k, v in WEIGHTS.items() if v == value]
        hit = F.lower(F.trim(key)).isin(names)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(DEFAULT_WEIGHT))


def rarity(n: Column) -> Column:
    """1 for two owners, less for each more; 0 for fewer."""
    return F.when(n < 2, F.lit(0.0)).otherwise(F.lit(1.0) / (n - 1))


def match_confidence(key: Column, n: Column, same_key: Column) -> Column:
    c = weight_for(key) * rarity(n) * F.when(same_key, F.lit(1.0)).otherwise(F.lit(CROSS_KEY))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def noisy_or(confidence: Column) -> Column:
    """Aggregate: the chance that one reason at least holds."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return F.coalesce(1 - F.product(1 - c), F.lit(0.0))
