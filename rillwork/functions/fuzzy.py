"""Sugeno measures and Choquet integrals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR, CEILING = 0.01, 0.99


def density(r2: Column) -> Column:
    """A model's worth: its out-of-fold R2 between 0.01 and 0.99."""
    return F.greatest(F.least(r2, F.lit(CEILING)), F.lit(FLOOR))


def sugeno_lambda3(a: Column, b: Column, c: Column) -> Column:
    """The root above -1, not 0, of 1 + x = (1 + ax)(1 + bx)(1 + cx); 0 where the densities add up to 1."""
    e1, e2, e3 = a + b + c, a * b + a * c + b * c, a * b * c
    root = 2 * (1 - e1) / (e2 + F.sqrt(e2 * e2 - 4 * e3 * (e1 - 1)))
    return F.when(F.abs(e1 - 1) <= 1e-12, 0.0).otherwise(root)


def sugeno_lambda(densities: Column, steps: int = 100) -> Column:
    """The same for an array of two or more densities, by bisection of log(1 + x) - sum log(1 + gx).

    Sums below 1 have a root above 0, which is first enclosed by doubling; sums above 1 one between -1 and 0."""
    total = F.aggregate(densities, F.lit(0.0), lambda s, g: s + g)

    def gap(x: Column) -> Column:
        return F.log1p(x) - F.aggregate(densities, F.lit(0.0), lambda s, g: s + F.log1p(g * x))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.lit(1.0), lambda x, _: F.when(gap(x) > 0, x * 2).otherwise(x))
    low = F.when(total < 1, F.lit(1e-9)).otherwise(F.lit(-1 + 1e-15))
    high = F.when(total < 1, grown).otherwise(F.lit(-1e-9))
    start = F.struct(low.alias("a"), high.alias("b"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        left = F.when(total < 1, gap(mid) > 0, ).otherwise(gap(mid) < 0)
        return F.struct(F.when(left, mid).otherwise(s["a"]).alias("a"), F.when(left, s["b"]).otherwise(mid).alias("b"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["a"] + s["b"]) / 2)
    return F.when(F.abs(total - 1) <= 1e-12, 0.0).otherwise(found)


def choquet(pairs: Column, lam: Column) -> Column:
    """Choquet integral of an array of structs (value, density) under lambda: values from the greatest down, each
    weighted by what it adds to the measure."""
    down = F.reverse(F.array_sort(pairs))
    start = F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        more = x["density"] + lam * acc["g"] * x["density"]
        return F.struct((acc["g"] + more).alias("g"), (acc["s"] + x["value"] * more).alias("s"))

    return F.aggregate(down, start, step, lambda acc: acc["s"])


def pairs(values: list[str], densities: list[str]) -> Column:
    return F.array(*[F.struct(F.col(v).alias("value"), F.col(d).alias("density")) for v, d in zip(values, densities, strict=True)])


def owa_weights(g: Column, n: int, lam: Column) -> Column:
    """Rank weights when all n densities are g: g * (1 + lambda * g) ** (rank - 1)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: g * F.pow(1 + lam * g, j))


def rank_weights(densities: Column, lam: Column) -> Column:
    """What each density adds to the measure, greatest density first."""
    down = F.reverse(F.array_sort(densities))
    start = F.struct(F.lit(0.0).alias("g"), F.array().cast("array<double>").alias("w"))

    def step(acc: Column, x: Column) -> Column:
        more = x + lam * acc["g"] * x
        return F.struct((acc["g"] + more).alias("g"), F.concat(acc["w"], F.array(more)).alias("w"))

    return F.aggregate(down, start, step, lambda acc: acc["w"])


def degeneracy(densities: Column, lam: Column, n: int) -> dict[str, Column]:
    """Whether the measure still tells models apart: weight_on_min, spread, all_at_floor, operator, degenerate."""
    w = rank_weights(densities, lam)
    last = F.element_at(w, -1)
    spread = F.array_max(densities) - F.array_min(densities)
    floor = F.forall(densities, lambda g: F.abs(g - FLOOR) <= 1e-9)
    equal = F.forall(w, lambda x: F.abs(x - 1.0 / n) <= 1e-5)
    operator = F.when(spread >= 1e-6, "competence-weighted (non-degenerate)").when(last > 0.80, "minimum-like OWA").when(equal, "arithmetic mean").otherwise("rank-weighted OWA (no model discrimination)")
    return {"weight_on_min": last, "spread": spread, "all_at_floor": floor, "operator": operator, "degenerate": (spread < 1e-6) | floor}
