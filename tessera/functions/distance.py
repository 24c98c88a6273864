"""Vector distances as JVM expressions: no Python worker touches a vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_sql(values) -> str:
    """A literal array<double>."""
    return "array(" + ", ".join(f"{float(v)!r}D" if abs(float(v)) != float("inf") and v == v else f"double('{float(v)}')" for v in values) + ")"


def _sum_sql(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)"


def cosine_distance_sql(a: str, b: str) -> str:
    """1 - cosine, 1 for a zero vector, an error for different lengths, null for null."""
    dot, na, nb = _sum_sql(a, b), _sum_sql(a, a), _sum_sql(b, b)
    bad = f"raise_error(concat('vectors of ', size({a}), ' and ', size({b}), ' dimensions'))"
    return (
        f"case when {a} is null or {b} is null then cast(null as double) when size({a}) != size({b}) then cast({bad} as double) "
        f"when {na} = 0D or {nb} = 0D then 1D else 1D - greatest(-1D, least(1D, {dot} / (sqrt({na}) * sqrt({nb})))) end"
    )


def cosine_distance(a: str, query) -> Column:
    """Distance of vector column ``a`` to a literal vector, or to the column named by a string."""
    return F.expr(cosine_distance_sql(f"`{a}`", f"`{query}`" if isinstance(query, str) else vector_sql(query)))
