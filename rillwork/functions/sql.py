"""The library's functions by name in spark.sql: scalar ones as SQL functions, which Catalyst inlines like the column
expressions, and window features as an Arrow table function."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rillwork.functions.zones import zone_sql

_TOTAL = "aggregate(g, 0D, (s, x) -> s + x)"


def _gap(x: str) -> str:
    return f"(log1p({x}) - aggregate(g, 0D, (s, d) -> s + log1p(d * ({x}))))"


_GROWN = f"aggregate(sequence(1, 64), 1D, (x, i) -> CASE WHEN {_gap('x')} > 0 THEN x * 2 ELSE x END)"
_MID = "(h.a + h.b) / 2"
_HALVED = f"CASE WHEN (1 - {_TOTAL}) * {_gap(_MID)} > 0 THEN named_struct('a', {_MID}, 'b', h.b) ELSE named_struct('a', h.a, 'b', {_MID}) END"
_START = f"CASE WHEN {_TOTAL} < 1 THEN named_struct('a', 1e-9D, 'b', {_GROWN}) ELSE named_struct('a', -1D + 1e-15D, 'b', -1e-9D) END"

#: name: (arguments, type, expression)
SCALARS = {
    # Sugeno measures: densities as an array; values and densities in the same order.
    "sugeno_lambda": ("g ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN abs({_TOTAL} - 1) <= 1e-12D THEN 0D ELSE aggregate(sequence(1, 80), {_START}, (h, i) -> {_HALVED}, h -> {_MID}) END"),
    "choquet": (
        "v ARRAY<DOUBLE>, g ARRAY<DOUBLE>, lambda DOUBLE",
        "DOUBLE",
        "aggregate(reverse(array_sort(zip_with(v, g, (x, y) -> named_struct('v', x, 'g', y)))), named_struct('m', 0D, 's', 0D), (a, p) -> named_struct('m', a.m + p.g + lambda * a.m * p.g, 's', a.s + p.v * (p.g + lambda * a.m * p.g)), a -> a.s)",
    ),
    "owa_weights": ("g DOUBLE, n INT, lambda DOUBLE", "ARRAY<DOUBLE>", "transform(sequence(0, n - 1), j -> g * pow(1 + lambda * g, j))"),
    "parkes_zone": ("reference DOUBLE, prediction DOUBLE", "STRING", f"CASE WHEN isnan(reference) OR isnan(prediction) THEN NULL ELSE {zone_sql('reference', 'prediction')} END"),
    # What aggregates are made of: rmse is sqrt(avg(sq_error(y, p))), mard 100 * avg(rel_error(y, p)), a zone's share
    # 100 * avg(in_zones(y, p, 'AB')), and r2 takes the count, the sum of sq_error and var_pop of the target.
    "sq_error": ("y DOUBLE, p DOUBLE", "DOUBLE", "(p - y) * (p - y)"),
    "rel_error": ("y DOUBLE, p DOUBLE", "DOUBLE", "abs(p - y) / nullif(y, 0D)"),
    "r2": ("n BIGINT, squares DOUBLE, variance DOUBLE", "DOUBLE", "1 - squares / nullif(n * variance, 0D)"),
}
AFTER = {"in_zones": ("y DOUBLE, p DOUBLE, letters STRING", "DOUBLE", "CASE WHEN parkes_zone(y, p) IS NULL THEN NULL WHEN contains(letters, parkes_zone(y, p)) THEN 1D ELSE 0D END")}


def _window_features():
    """window_features(TABLE(SELECT key, x ...)): key BIGINT and the ten features of each window x (array of doubles); null
    where a window has none."""
    from rillwork.operators.features import BATCH, TEN, ten_features_of

    class WindowFeatures:
        def eval(self, table: pa.RecordBatch):
            for at in range(0, table.num_rows, BATCH):
                part = table.slice(at, BATCH)
                wide = ten_features_of(part.column(1))
                yield pa.table([part.column(0).cast(pa.int64()), *(pa.array(v, pa.float64(), mask=m) for v, m in wide)], names=["key", *TEN])

    return F.arrow_udtf(WindowFeatures, returnType="key bigint, " + ", ".join(f"{t} double" for t in TEN))


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, as temporary ones; again does no harm."""
    for name, (arguments, kind, body) in (SCALARS | AFTER).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("window_features", _window_features())
