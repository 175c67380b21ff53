"""Set and sequence similarities of prepared columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.functions import matching


def _guarded(a: Column, b: Column, value: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(value)


def jaccard(a: Column, b: Column) -> Column:
    return _guarded(a, b, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    return _guarded(a, b, F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters of two sequences, in this order; 0 if either is empty. Equal pairs of a batch are worked out once."""
    places: dict[tuple[str, str], int] = {}
    at = [places.setdefault((x, y), len(places)) if x and y else -1 for x, y in zip(a, b, strict=True)]
    found = np.append(matching.ratios([x for x, _ in places], [y for _, y in places]), 0.0)
    return pd.Series(found[np.array(at, dtype=int)], dtype=float)


def ratio_bound(a: Column, b: Column) -> Column:
    """No sequence ratio of the two can be higher."""
    la, lb = F.length(a), F.length(b)
    return F.when((la == 0) | (lb == 0), 0.0).otherwise(2.0 * F.least(la, lb) / (la + lb))
