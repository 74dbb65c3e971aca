"""Vector expressions: float32 in, double accumulation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def is_valid(v: Column | str, dim: int) -> Column:
    """Finite, of the right dimension, not zero."""
    v = F.col(v) if isinstance(v, str) else v
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & finite & (l2_norm(v) > 0), F.lit(False))


def l2_normalize(v: Column | str) -> Column:
    """Unit length; zero or not finite is an error, as for a broken encoder."""
    v = F.col(v) if isinstance(v, str) else v
    n = l2_norm(v)
    return F.when((n > 0) & (n < F.lit(float("inf"))), F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.raise_error(F.lit("vector has no direction")))


def truncate_dim(v: Column | str, dim: int) -> Column:
    """The first dim numbers, normalised again."""
    return l2_normalize(F.slice(v, 1, dim))
