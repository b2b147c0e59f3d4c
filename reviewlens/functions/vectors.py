"""Column-level vector math on ``ARRAY<DOUBLE|FLOAT>``.

Built from ``zip_with`` / ``aggregate`` / ``transform`` so the work stays in
the JVM; vectors are cast to double first so results do not depend on float
accumulation order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """cosine similarity; NULL when either vector is all zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sq_l2(a: Column | str, b: Column | str) -> Column:
    """squared Euclidean distance."""
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance."""
    return F.sqrt(sq_l2(a, b))


def triplet_margin(anc: Column | str, pos: Column | str, neg: Column | str,
                   margin: float = .01) -> Column:
    """max(0, |a-p|^2 - |a-n|^2 + margin) on squared distances."""
    return F.greatest(F.lit(0.0), sq_l2(anc, pos) - sq_l2(anc, neg) + F.lit(margin))


def scale(a: Column | str, factor: Column | float) -> Column:
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(_c(a), lambda x: x * f)
