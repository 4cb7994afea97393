"""Column expressions usable in any select: no Python runs for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: lambdas do not share repeated subexpressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def convex_hull_area(points: str | Column) -> Column:
    """Area of the convex hull of an array of structs (x, y); 0 below three points.

    Monotone chain: one fold over the sorted points per side, each dropping the points that turn the wrong way.
    """

    def cross(o: Column, a: Column, b: Column) -> Column:
        return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])

    def chain(array: Column) -> Column:
        empty = F.filter(array, lambda _: F.lit(False))

        def push(hull: Column, p: Column) -> Column:
            # drop from the end while the last two points and p do not turn left: keep the longest good prefix
            def turns(n: Column) -> Column:
                return (n < 2) | (cross(F.element_at(hull, (n - 1).cast("int")), F.element_at(hull, n.cast("int")), p) > 0)

            size = F.size(hull)
            keep = F.aggregate(
                F.sequence(F.lit(0), size), size,
                lambda n, _: F.when(F.when(n < 2, True).otherwise(turns(n)), n).otherwise(n - 1),
            )
            return F.array_append(F.slice(hull, 1, keep), p)

        return F.aggregate(array, empty, push)

    def twice_area(array: Column) -> Column:
        n = F.size(array)
        following = lambda i: F.element_at(array, ((i + 1) % n + 1).cast("int"))
        terms = F.transform(array, lambda p, i: p["x"] * following(i)["y"] - p["y"] * following(i)["x"])
        return F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t))

    def open_end(hull: Column) -> Column:
        return let(hull, lambda h: F.slice(h, 1, F.size(h) - 1))

    def area(ordered: Column) -> Column:
        # both chains share their end points
        ring = F.concat(open_end(chain(ordered)), open_end(chain(F.reverse(ordered))))
        return F.when(F.size(ordered) >= 3, let(ring, twice_area) / 2).otherwise(F.lit(0.0))

    return let(F.array_sort(points), area)


def power_terms(t: Column, y: Column) -> dict[str, Column]:
    """What has to be summed over the points for ``parabola``."""
    tt = t * t
    return {"n": F.lit(1.0), "s1": t, "s2": tt, "s3": tt * t, "s4": tt * tt, "y0": y, "y1": t * y, "y2": tt * y, "yy": y * y}


def parabola(sums: dict[str, Column]) -> dict[str, Column]:
    """Least-squares y = a*t^2 + b*t + c from sums of ``power_terms``: a, b, c and r2.

    ``t`` should be small (relative to a nearby origin) to keep the sums precise.
    """
    n, s1, s2, s3, s4, y0, y1, y2, yy = (sums[k] for k in ("n", "s1", "s2", "s3", "s4", "y0", "y1", "y2", "yy"))
    det = s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    a = (y2 * (s2 * n - s1 * s1) - s3 * (y1 * n - s1 * y0) + s2 * (y1 * s1 - s2 * y0)) / det
    b = (s4 * (y1 * n - s1 * y0) - y2 * (s3 * n - s1 * s2) + s2 * (s3 * y0 - y1 * s2)) / det
    c = (s4 * (s2 * y0 - y1 * s1) - s3 * (s3 * y0 - y1 * s2) + y2 * (s3 * s1 - s2 * s2)) / det
    sst = yy - y0 * y0 / n
    ssr = yy - a * y2 - b * y1 - c * y0
    r2 = F.when(sst > 1e-9, 1 - F.greatest(ssr, F.lit(0.0)) / sst).otherwise(F.lit(0.0))
    return {k: F.when(det != 0, v) for k, v in (("a", a), ("b", b), ("c", c), ("r2", r2))}
