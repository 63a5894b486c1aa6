"""Consensus error-grid zones as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: mg/dL in one mmol/L of glucose.
MGDL = 18.018
# Corners of the grid's boundaries in mg/dL. Upper ones give a prediction's limit at a reference value,
# lower ones a reference's limit at a prediction (written here as prediction, reference).
UPPER = {
    "B": [(0, 50), (30, 50), (140, 170), (280, 380), (430, 550)],
    "C": [(0, 60), (30, 60), (50, 80), (70, 110), (260, 550)],
    "D": [(0, 100), (25, 100), (50, 125), (80, 215), (125, 550)],
    "E": [(0, 150), (35, 155), (50, 550)],
}
LOWER = {
    "B": [(0, 50), (30, 50), (145, 170), (300, 385), (450, 550)],
    "C": [(0, 120), (30, 120), (130, 260), (250, 550)],
    "D": [(0, 250), (40, 250), (150, 550)],
}


def piecewise(x: Column, corners: list[tuple[float, float]]) -> Column:
    """Straight lines between corners, flat outside them."""
    out = F.when(x <= corners[0][0], F.lit(float(corners[0][1])))
    for (a, u), (b, v) in zip(corners, corners[1:], strict=False):
        out = out.when(x <= b, F.lit(float(u)) + (x - a) * (float(v - u) / (b - a)))
    return out.otherwise(F.lit(float(corners[-1][1])))


def zone(reference: Column, prediction: Column) -> Column:
    """Letter A to E of a prediction in mmol/L; null where either value is null or not a number.

    Over-estimates meet the upper boundaries, all others the lower ones; the worst boundary that is crossed counts."""
    ref, pred = reference * MGDL, prediction * MGDL
    out = F.when(reference.isNull() | prediction.isNull() | F.isnan(reference) | F.isnan(prediction), F.lit(None).cast("string"))
    over = pred > ref
    for letter in "EDCB":
        out = out.when(over & (pred > piecewise(ref, UPPER[letter])), letter)
        if letter in LOWER:
            out = out.when(~over & (ref > piecewise(pred, LOWER[letter])), letter)
    return out.otherwise("A")


def zone_sql(ref: str, pred: str) -> str:
    """The same as SQL text over two expressions in mmol/L."""

    def line(x: str, corners) -> str:
        parts = [f"WHEN {x} <= {corners[0][0]} THEN {corners[0][1]}.0"]
        parts += [f"WHEN {x} <= {b} THEN {u}.0 + ({x} - {a}) * CAST({(v - u) / (b - a)!r} AS DOUBLE)" for (a, u), (b, v) in zip(corners, corners[1:], strict=False)]
        return f"CASE {' '.join(parts)} ELSE {corners[-1][1]}.0 END"

    r, p, cases = f"(({ref}) * CAST({MGDL} AS DOUBLE))", f"(({pred}) * CAST({MGDL} AS DOUBLE))", []
    for letter in "EDCB":
        cases.append(f"WHEN {p} > {r} AND {p} > {line(r, UPPER[letter])} THEN '{letter}'")
        if letter in LOWER:
            cases.append(f"WHEN {p} <= {r} AND {r} > {line(p, LOWER[letter])} THEN '{letter}'")
    return f"CASE WHEN ({ref}) IS NULL OR ({pred}) IS NULL THEN NULL {' '.join(cases)} ELSE 'A' END"
