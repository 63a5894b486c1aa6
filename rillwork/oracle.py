"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from rillwork.functions.zones import zone_sql

_MODELS = ["LastReading", "TrailingMean", "PastMean"]
_METHODS = [*_MODELS, "PlainAverage", "WeightedAverage", "Choquet", "MinOfModels", "NoSkillBaseline"]
_GAP = 1440


def _r(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) AS {name}"


_READ = "r AS (SELECT CAST(user_id AS VARCHAR) AS subject, ts, event_type, value / CAST(18.018 AS DOUBLE) AS glucose FROM events WHERE value IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL)"


def _fold(k: int, seed: int = 42) -> str:
    return f"CAST(CAST('0x' || substr(md5(concat_ws(':', subject, CAST(epoch_us(ts) AS VARCHAR), '{seed}')), 1, 8) AS BIGINT) % {k} AS INTEGER)"


_CAUSAL = """c AS (SELECT * FROM (SELECT subject, ts, glucose, lag(glucose) OVER w AS "LastReading",
  avg(glucose) OVER (PARTITION BY subject ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS "TrailingMean",
  avg(glucose) OVER (PARTITION BY subject ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "PastMean"
  FROM r WINDOW w AS (PARTITION BY subject ORDER BY ts)) WHERE "LastReading" IS NOT NULL)"""
_FOLDED = f"p AS (SELECT *, {_fold(5)} AS fold FROM c)"


def _lambda3(a: str, b: str, c: str) -> str:
    e1, e2, e3 = f"({a} + {b} + {c})", f"({a} * {b} + {a} * {c} + {b} * {c})", f"({a} * {b} * {c})"
    return f"CASE WHEN abs({e1} - 1) <= 1e-12 THEN 0.0 ELSE 2 * (1 - {e1}) / ({e2} + sqrt({e2} * {e2} - 4 * {e3} * ({e1} - 1))) END"


def _choquet3(v: list[str], g: list[str], lam: str) -> str:
    s = "list_reverse_sort([" + ", ".join(f"{{'v': {a}, 'g': {b}}}" for a, b in zip(v, g, strict=True)) + "])"
    g1, g2, g3 = (f"{s}[{i}].g" for i in (1, 2, 3))
    two = f"({g1} + {g2} + {lam} * {g1} * {g2})"
    return f"({s}[1].v * {g1} + {s}[2].v * ({g2} + {lam} * {g1} * {g2}) + {s}[3].v * ({g3} + {lam} * {two} * {g3}))"


_G = [f"g_{m}" for m in _MODELS]
_DENSITY = (
    "s AS (SELECT fold, count(*) AS n, sum(glucose) AS y, sum(glucose * glucose) AS yy, "
    + ", ".join(f'sum(("{m}" - glucose) * ("{m}" - glucose)) AS e_{m}' for m in _MODELS)
    + " FROM p GROUP BY fold), s0 AS (SELECT sum(n) AS n, sum(y) AS y, sum(yy) AS yy, "
    + ", ".join(f"sum(e_{m}) AS e_{m}" for m in _MODELS)
    + " FROM s), s1 AS (SELECT s.fold, "
    + ", ".join(f"greatest(least(1 - (s0.e_{m} - s.e_{m}) / ((s0.yy - s.yy) - (s0.y - s.y) * (s0.y - s.y) / (s0.n - s.n)), 0.99::DOUBLE), 0.01::DOUBLE) AS g_{m}" for m in _MODELS)
    + f", (s0.y - s.y) / (s0.n - s.n) AS base FROM s, s0), d AS (SELECT *, {_lambda3(*_G)} AS lam FROM s1)"
)
_Q = [f'"{m}"' for m in _MODELS]
_WIDE = (
    f'w AS (SELECT p.*, ({_Q[0]} + {_Q[1]} + {_Q[2]}) / 3 AS "PlainAverage", ({" + ".join(f"{q} * {g}" for q, g in zip(_Q, _G, strict=True))}) / ({" + ".join(_G)}) AS "WeightedAverage", '
    f'{_choquet3(_Q, _G, "lam")} AS "Choquet", least({", ".join(_Q)}) AS "MinOfModels", base AS "NoSkillBaseline" FROM p JOIN d ON d.fold = p.fold)'
)
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT subject, ts, glucose, fold, '{m}' AS method, \"{m}\" AS pred FROM w" for m in _METHODS) + ")"
PREDICTED = f"WITH {_READ}, {_CAUSAL}, {_FOLDED}"
GRADED = f"{PREDICTED}, {_DENSITY}, {_WIDE}, {_LONG}, z AS (SELECT *, {zone_sql('glucose', 'pred')} AS zone FROM l)"

_RAW = {
    "r2": "1 - sum((glucose - pred) * (glucose - pred)) / nullif(count(*) * var_pop(glucose), 0)",
    "rmse": "sqrt(avg((pred - glucose) * (pred - glucose)))",
    "mard": "avg(abs(pred - glucose) / nullif(glucose, 0)) * 100",
    "zone_a": "avg(CASE WHEN zone = 'A' THEN 1.0 ELSE 0.0 END) * 100",
    "zone_ab": "avg(CASE WHEN zone IN ('A', 'B') THEN 1.0 ELSE 0.0 END) * 100",
}
_GRADES = ", ".join(_r(v, k) for k, v in _RAW.items())
_BARE = ", ".join(f"{v} AS {k}" for k, v in _RAW.items())


def _runs(source: str, name: str, gap: int, keep: str) -> str:
    return f"""{name} AS (SELECT {keep}, sum(b) OVER (PARTITION BY subject ORDER BY ts) AS run FROM (SELECT *, CASE WHEN (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY subject ORDER BY ts)) / 60e6 > {gap} THEN 1 ELSE 0 END AS b FROM {source}))"""


def _sessions(kind: str) -> str:
    return f"""e_{kind} AS (SELECT * FROM r WHERE event_type = '{kind}'), {_runs(f"e_{kind}", f"n_{kind}", 3 * _GAP, "subject, ts")},
  s_{kind} AS (SELECT subject, '{kind}' AS device, concat_ws('-', '{kind}', CAST(CAST(run AS BIGINT) AS VARCHAR)) AS session_id, min(ts) AS t_start, max(ts) AS t_end, count(*) AS n FROM n_{kind} GROUP BY subject, run)"""


_PAIR = f"""WITH {_READ}, {_sessions("view")}, {_sessions("click")}, q AS (SELECT subject, ts, glucose FROM r WHERE event_type = 'purchase')"""
_BOTH = (
    _PAIR
    + """, a AS (SELECT q.*, s.session_id AS first_session FROM q JOIN s_view s ON s.subject = q.subject AND q.ts BETWEEN s.t_start AND s.t_end),
  b AS (SELECT q.subject, q.ts, min(s.session_id) AS second_session FROM q JOIN s_click s ON s.subject = q.subject AND q.ts BETWEEN s.t_start AND s.t_end GROUP BY 1, 2),
  m AS (SELECT a.subject, a.ts, any_value(a.glucose) AS glucose, min(a.first_session) AS first_session, min(b.second_session) AS second_session FROM a JOIN b ON a.subject = b.subject AND a.ts = b.ts GROUP BY 1, 2)"""
)
_X = "x AS (SELECT vec_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
_SPEC = f"""WITH {_X}, f AS (SELECT vec_id, k, sum(x * cos(2 * pi() * ((k * i) % 64) / 64)) AS re, sum(x * sin(2 * pi() * ((k * i) % 64) / 64)) AS im FROM x, range(0, 33) t(k) GROUP BY vec_id, k),
  g AS (SELECT *, re * re + im * im AS p, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS n FROM f)"""
_PEAK = f"""WITH RECURSIVE {_X}, t AS (SELECT vec_id, median(x) + 0.2 * stddev_pop(x) AS least FROM x GROUP BY vec_id),
  c AS (SELECT * FROM (SELECT x.vec_id, i, x, least, lag(x) OVER w AS b, lead(x) OVER w AS a FROM x JOIN t ON t.vec_id = x.vec_id WINDOW w AS (PARTITION BY x.vec_id ORDER BY i)) WHERE x > b AND x >= a AND x >= least),
  k AS (SELECT vec_id, i, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i DESC) AS r FROM c),
  g(vec_id, r, kept) AS (SELECT vec_id, 1::BIGINT, [i]::BIGINT[] FROM k WHERE r = 1 UNION ALL
    SELECT g.vec_id, k.r, CASE WHEN len(list_filter(g.kept, lambda o: abs(o - k.i) < 5)) > 0 THEN g.kept ELSE list_append(g.kept, k.i) END FROM g JOIN k ON k.vec_id = g.vec_id AND k.r = g.r + 1),
  pk AS (SELECT k.vec_id, k.i, k.x FROM k JOIN (SELECT vec_id, arg_max(kept, r) AS kept FROM g GROUP BY vec_id) q ON q.vec_id = k.vec_id AND list_contains(q.kept, k.i))"""
_FEATURES = """f AS (SELECT CAST(l_suppkey AS VARCHAR) AS subject, l_shipdate AS ts, l_extendedprice / 1000 AS glucose, l_quantity, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
  CAST(month(l_shipdate) AS DOUBLE) AS ship_month, CAST(day(l_shipdate) AS DOUBLE) AS ship_day, CAST(dayofweek(l_shipdate) + 1 AS DOUBLE) AS ship_weekday, CAST(l_partkey % 10 AS DOUBLE) AS part_mod, CAST(l_suppkey % 7 AS DOUBLE) AS supp_mod FROM lineitem)"""
_NAMES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "ship_month", "ship_day", "ship_weekday", "part_mod", "supp_mod"]
_CORR = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS place, corr({c}, glucose) AS r, count(*) AS n FROM f" for i, c in enumerate(_NAMES))
_OWA = "g AS (SELECT DISTINCT l_discount AS g FROM lineitem WHERE l_discount > 0), o AS (SELECT g, " + _lambda3("g", "g", "g") + " AS lam FROM g)"


def _smooth_sql(source: str, value: str, g: str, n: int = 7) -> str:
    """Choquet of the trailing run with equal densities g: rank weights g * (1 + lam * g) ** (rank - 1)."""
    return f"""SELECT q.*, CASE WHEN len(v) = 1 THEN {value} ELSE list_sum(list_transform(list_reverse_sort(v), lambda a, i: a * {g} * pow(1 + lam * {g}, i - 1))) END AS smoothed
      FROM (SELECT *, list({value}) OVER (PARTITION BY subject, run ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS v FROM {source}) q JOIN lams ON lams.k = len(q.v)"""


def _lams(g: str, n: int = 7) -> str:
    """lambda of k equal densities by bisection, as a recursive table."""
    return f"""bis(k, lo, hi, step) AS (SELECT k, CASE WHEN k * {g} < 1 THEN 1e-9 ELSE -1 + 1e-15 END, CASE WHEN k * {g} < 1 THEN 1e9 ELSE -1e-9 END, 0 FROM range(1, {n + 1}) t(k)
      UNION ALL SELECT k, CASE WHEN (ln(1 + (lo + hi) / 2) - k * ln(1 + {g} * (lo + hi) / 2) > 0) = (k * {g} < 1) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN (ln(1 + (lo + hi) / 2) - k * ln(1 + {g} * (lo + hi) / 2) > 0) = (k * {g} < 1) THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM bis WHERE step < 120),
      lams AS (SELECT k, CASE WHEN k = 1 OR abs(k * {g} - 1) <= 1e-12 THEN 0.0 ELSE (lo + hi) / 2 END AS lam FROM bis WHERE step = 120)"""


def _verdict() -> str:
    return f"{GRADED}, m AS (SELECT method, {_BARE} FROM z GROUP BY method) SELECT a.method, {_r('a.r2', 'r2')}, {_r('b.r2', 'control_r2')}, CASE WHEN a.r2 > b.r2 + 0.02 THEN 'better' ELSE 'no better' END AS verdict FROM m a, m b WHERE b.method = 'NoSkillBaseline' AND a.method <> 'NoSkillBaseline'"


_SIZES = "n AS (SELECT subject, count(*) AS n FROM r GROUP BY subject)"
_GROUP = f"""WITH RECURSIVE {_READ}, {_SIZES}, o AS (SELECT *, row_number() OVER (ORDER BY n DESC, subject) AS k FROM n),
  t(k, load, subject, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], ''::VARCHAR, 0 UNION ALL
    SELECT o.k, list_transform(t.load, lambda x, i: CASE WHEN i = list_position(t.load, list_min(t.load)) THEN x + o.n ELSE x END), o.subject, CAST(list_position(t.load, list_min(t.load)) AS INTEGER) FROM t JOIN o ON o.k = t.k + 1)"""
_ABLATE = {"no_last": _MODELS[1:], "no_trailing": [_MODELS[0], _MODELS[2]], "no_past": _MODELS[:2], "all": _MODELS}
_ZONES = ["America/Chicago", "America/New_York", "America/Denver", "America/Los_Angeles", "UTC"]
_CLOCK = f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS subject, ts AS t FROM events WHERE event_type = 'view'),
  loc AS (SELECT subject, (t AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' + INTERVAL 3 MINUTE AS t FROM e),
  zn AS (SELECT unnest({_ZONES!r}) AS zone, unnest(range(1, 6)) AS place),
  c AS (SELECT e.subject, zone, place, (t AT TIME ZONE 'UTC') AT TIME ZONE zone AS t FROM e, zn),
  sc AS (SELECT c.subject, zone, place, count(*) FILTER (EXISTS (SELECT 1 FROM loc WHERE loc.subject = c.subject AND abs(epoch_us(loc.t) - epoch_us(c.t)) < 1200000000)) AS matches FROM c GROUP BY 1, 2, 3)"""


def _proto(name: str, fold: str, extra: str = "") -> str:
    return f"""f_{name} AS (SELECT c.*, {fold} AS fold FROM c {extra}), b_{name} AS (SELECT fold, sum(glucose) AS s, count(*) AS n FROM f_{name} GROUP BY fold),
  k_{name} AS (SELECT fold, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS base FROM b_{name}), y_{name} AS (SELECT f.*, base AS "NoSkillBaseline" FROM f_{name} f JOIN k_{name} k ON k.fold = f.fold)"""


_PROTOCOLS = f"""WITH RECURSIVE {_READ}, {_CAUSAL}, cn AS (SELECT subject, count(*) AS n FROM c GROUP BY subject), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, subject) AS k FROM cn),
  t(k, load, subject, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], ''::VARCHAR, 0::BIGINT UNION ALL
    SELECT o.k, list_transform(t.load, lambda x, i: CASE WHEN i = list_position(t.load, list_min(t.load)) THEN x + o.n ELSE x END), o.subject, list_position(t.load, list_min(t.load)) FROM t JOIN o ON o.k = t.k + 1),
  {_proto("random_window", _fold(5))}, {_proto("subject_aware", "t.fold", "JOIN t ON t.subject = c.subject")}, {_proto("loso", "o.k", "JOIN o ON o.subject = c.subject")}"""
_PROTOCOLS += " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS method, " + ", ".join(f"(SELECT round(1 - sum((glucose - \"{m}\") * (glucose - \"{m}\")) / (count(*) * var_pop(glucose)), 6) FROM y_{p}) AS {p}" for p in ("random_window", "subject_aware", "loso")) for m in [*_MODELS, "NoSkillBaseline"]
) + ")"

_MOMENTS = "m AS (SELECT vec_id, kurtosis_pop(x) AS kur, avg((x - u) * (x - u) * (x - u)) / pow(var_pop(x), 1.5) AS ske FROM (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS u FROM x) GROUP BY vec_id)"
_HJORTH = """d1 AS (SELECT vec_id, i, x, x - lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM x), d2 AS (SELECT *, d - lag(d) OVER (PARTITION BY vec_id ORDER BY i) AS dd FROM d1),
  h AS (SELECT vec_id, sqrt(var_pop(d) / var_pop(x)) AS sm, sqrt(var_pop(dd) / var_pop(d)) / sqrt(var_pop(d) / var_pop(x)) AS sc FROM d2 GROUP BY vec_id)"""
_ENTROPY = """mm AS (SELECT vec_id, min(x) AS lo, max(x) AS hi, count(*) AS n FROM x GROUP BY vec_id), bb AS (SELECT x.vec_id, n, least(floor((x - lo) / (hi - lo) * 64), 63) AS b, count(*) AS c FROM x JOIN mm ON mm.vec_id = x.vec_id GROUP BY ALL),
  en AS (SELECT vec_id, -sum(c / n * log2(c / n)) AS se FROM bb GROUP BY vec_id)"""
_EMBED = "v AS (SELECT * FROM (SELECT vec_id, i, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY i)) WHERE c IS NOT NULL)"
_LOW = [-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523]
_HIGH = [(-1) ** (j + 1) * h for j, h in enumerate(reversed(_LOW))]


def _wave(source: str, taps: list[float], name: str) -> str:
    """Convolution at odd places of a signal mirrored at its ends, by index into it."""
    values = ", ".join(f"({j}, CAST({h!r} AS DOUBLE))" for j, h in enumerate(taps))
    at = "o.o * 2 + 1 - t.j"
    return f"""{name} AS (SELECT o.vec_id, o.o, sum(s.x * t.h) AS x FROM (SELECT vec_id, n, unnest(range(0, (n + 7) // 2)) AS o FROM (SELECT vec_id, count(*) AS n FROM {source} GROUP BY vec_id)) o
      CROSS JOIN (VALUES {values}) t(j, h) JOIN {source} s ON s.vec_id = o.vec_id AND s.i = CASE WHEN {at} < 0 THEN -1 - ({at}) WHEN {at} >= o.n THEN 2 * o.n - 1 - ({at}) ELSE {at} END GROUP BY o.vec_id, o.o)"""


SQL = {
    "reading_clean": f"WITH {_READ} SELECT subject, ts, {_r('glucose', 'glucose')} FROM r WHERE event_type IN ('view', 'click')",
    "subject_summary": f"WITH {_READ} SELECT subject, count(*) AS n, {_r('min(glucose)', 'lo')}, {_r('max(glucose)', 'hi')}, {_r('stddev_samp(glucose)', 'sd')}, count(DISTINCT glucose) AS kinds FROM r GROUP BY subject",
    "top_subjects": f"WITH {_READ} SELECT subject, count(*) AS n FROM r GROUP BY subject ORDER BY n DESC, subject LIMIT 10",
    "contiguous_runs": f"WITH {_READ}, {_runs('r', 'u', _GAP, 'subject, ts, glucose')} SELECT subject, CAST(run AS BIGINT) AS run, min(ts) AS t_start, max(ts) AS t_end, count(*) AS n, {_r('avg(glucose)', 'mean')} FROM u GROUP BY subject, run",
    "day_index": f"""WITH {_READ}, b AS (SELECT subject, ts, row_number() OVER w - 1 AS ordinal, CASE WHEN CAST(ts AS DATE) = lag(CAST(ts AS DATE)) OVER w THEN 0 ELSE 1 END AS b FROM r WINDOW w AS (PARTITION BY subject ORDER BY ts)),
      s AS (SELECT subject, ts, ordinal, CAST(sum(b) OVER (PARTITION BY subject ORDER BY ts) AS BIGINT) AS day_no FROM b) SELECT *, 'day ' || CAST(day_no AS VARCHAR) AS label FROM s""",
    "capped_per_day": f"WITH {_READ} SELECT subject, strftime(ts, '%Y-%m-%d') AS day, ts, {_r('glucose', 'glucose')} FROM r QUALIFY row_number() OVER (PARTITION BY subject, CAST(ts AS DATE) ORDER BY ts) <= 2",
    "dedupe_first": "SELECT CAST(user_id AS VARCHAR) AS subject, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) = 1",
    "fold_hash": f"WITH {_READ} SELECT subject, ts, {_fold(5)} AS fold FROM r",
    "fold_group": f"{_GROUP} SELECT t.subject, t.fold, n.n FROM t JOIN n ON n.subject = t.subject",
    "fold_loso": f"WITH {_READ}, {_SIZES} SELECT subject, CAST(row_number() OVER (ORDER BY n DESC, subject) AS INTEGER) AS fold, n FROM n",
    "holdout_split": f"WITH {_READ} SELECT {_fold(5, 7)} = 0 AS test, count(*) AS n, {_r('avg(glucose)', 'mean')} FROM r GROUP BY 1",
    "noskill_baseline": f"WITH {_READ}, f AS (SELECT {_fold(5)} AS fold, sum(glucose) AS s, count(*) AS n FROM r GROUP BY 1) SELECT fold, {_r('(sum(s) OVER () - s) / (sum(n) OVER () - n)', '\"NoSkillBaseline\"')}, CAST(sum(n) OVER () - n AS BIGINT) AS n_train, n AS n_test FROM f",
    "fold_sizes": f"WITH {_READ}, f AS (SELECT {_fold(5)} AS fold, count(*) AS n FROM r GROUP BY 1) SELECT fold, CAST(sum(n) OVER () - n AS BIGINT) AS n_train, n AS n_test FROM f",
    "causal_predictions": f"{PREDICTED} SELECT subject, ts, {_r('glucose', 'glucose')}, {', '.join(_r(q, q) for q in _Q)}, fold FROM p",
    "fold_densities": f"{PREDICTED}, {_DENSITY} SELECT fold, {', '.join(_r(g, g) for g in _G)}, {_r('lam', 'lambda')} FROM d",
    "fused_predictions": f"{GRADED} SELECT subject, ts, fold, " + ", ".join(_r(f'"{m}"', f'"{m}"') for m in _METHODS) + " FROM w",
    "predictions_long": f"{GRADED} SELECT fold, method, count(*) AS n, {_r('sum(pred)', 'total', 4)} FROM l GROUP BY fold, method",
    "sugeno_lambda3": "WITH b AS (SELECT o_custkey, " + ", ".join(f"greatest(least(avg(CASE WHEN o_orderpriority[1] = '{k}' THEN 1.0 ELSE 0.0 END), 0.99::DOUBLE), 0.01::DOUBLE) AS {c}" for k, c in (("1", "a"), ("2", "b"), ("3", "c"))) + f" FROM orders GROUP BY o_custkey) SELECT o_custkey, {_r('a', 'a', 5)}, {_r('b', 'b', 5)}, {_r('c', 'c', 5)}, {_r(_lambda3('a', 'b', 'c'), 'lambda', 5)} FROM b",
    "sugeno_lambda_any": f"""SELECT g AS l_discount, n, {_r('(list_reduce(list_prepend(10.0::DOUBLE, list_transform(range(80), lambda k: 0.0::DOUBLE)), lambda u, k: u - (CASE n WHEN 2 THEN 1 + u WHEN 3 THEN 1 + u + u * u WHEN 4 THEN 1 + u + u * u + u * u * u ELSE 1 + u + u * u + u * u * u + u * u * u * u END - 1 / g) / CASE n WHEN 2 THEN 1 WHEN 3 THEN 1 + 2 * u WHEN 4 THEN 1 + 2 * u + 3 * u * u ELSE 1 + 2 * u + 3 * u * u + 4 * u * u * u END) - 1) / g', 'lambda', 4)}
      FROM (SELECT DISTINCT CAST(l_discount AS DOUBLE) AS g, n FROM lineitem, (VALUES (2), (3), (4), (5)) t(n) WHERE l_discount > 0)""",
    "choquet3": "WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity AS v1, l_extendedprice / 1000 AS v2, l_tax * 100 AS v3, greatest(least(l_discount, 0.99::DOUBLE), 0.01::DOUBLE) AS g1, 0.3::DOUBLE AS g2, greatest(least(l_tax, 0.99::DOUBLE), 0.01::DOUBLE) AS g3 FROM lineitem), w AS (SELECT *, " + _lambda3("g1", "g2", "g3") + f" AS lam FROM v) SELECT l_orderkey, l_linenumber, {_r(_choquet3(['v1', 'v2', 'v3'], ['g1', 'g2', 'g3'], 'lam'), 'fused', 8)} FROM w",
    "owa_weights": f"WITH {_OWA} SELECT {_r('g', 'g')}, {_r('lam', 'lam')}, {_r('g', 'w1')}, {_r('g * (1 + lam * g)', 'w2')}, {_r('g * pow(1 + lam * g, 2)', 'w3')} FROM o",
    "degeneracy_report": f"{PREDICTED}, {_DENSITY}, q AS (SELECT fold, lam, list_reverse_sort([{', '.join(_G)}]) AS g FROM d), k AS (SELECT fold, g, g[1] - g[3] AS spread, g[3] + lam * (g[1] + g[2] + lam * g[1] * g[2]) * g[3] AS w3, g[2] + lam * g[1] * g[2] AS w2 FROM q)"
    f" SELECT fold, {_r('w3', 'weight_on_min')}, {_r('spread', 'spread')}, g[1] <= 0.01 + 1e-9 AS all_at_floor, CASE WHEN spread >= 1e-6 THEN 'competence-weighted (non-degenerate)' WHEN w3 > 0.8 THEN 'minimum-like OWA' WHEN greatest(abs(w3 - 1.0 / 3), abs(w2 - 1.0 / 3), abs(g[1] - 1.0 / 3)) <= 1e-5 THEN 'arithmetic mean' ELSE 'rank-weighted OWA (no model discrimination)' END AS operator, spread < 1e-6 OR g[1] <= 0.01 + 1e-9 AS degenerate FROM k",
    "density_sweep": "WITH g AS (SELECT DISTINCT round((l_discount + l_tax) / 2, 6) AS g FROM lineitem WHERE (l_discount + l_tax) / 2 > 0.004 AND (l_discount + l_tax) / 2 < 1.0 / 3), o AS (SELECT g, " + _lambda3("g", "g", "g") + f" AS lam FROM g) SELECT {_r('g', 'g', 5)}, {_r('lam', 'lam', 5)}, {_r('g * pow(1 + lam * g, 2)', 'weight_on_min', 5)}, CASE WHEN g * pow(1 + lam * g, 2) > 0.8 THEN 'minimum-like OWA' ELSE 'rank-weighted OWA (no model discrimination)' END AS operator FROM o",
    "temporal_choquet": f"WITH RECURSIVE {_READ}, {_runs('r', 'u', _GAP, 'subject, ts, glucose')}, {_lams('(1.0::DOUBLE / 7)')}, sm AS ({_smooth_sql('u', 'glucose', '(1.0::DOUBLE / 7)')}) SELECT subject, ts, CAST(run AS BIGINT) AS run, {_r('glucose', 'glucose', 5)}, {_r('smoothed', 'smoothed', 5)} FROM sm",
    "zone_label": f"{PREDICTED} SELECT subject, ts, {zone_sql('glucose', '\"LastReading\"')} AS zone FROM p",
    "zone_pct_by_method": f"{GRADED} SELECT method, " + ", ".join(_r(f"avg(CASE WHEN zone = '{z}' THEN 1.0 ELSE 0.0 END) * 100", f"zone_{z.lower()}") for z in "ABCDE") + " FROM z GROUP BY method",
    "zone_distribution": f"{GRADED} SELECT method, " + ", ".join(f"count(*) FILTER (zone = '{z}') AS \"{z}\"" for z in "ABCDE") + " FROM z GROUP BY method",
    "grade_pooled": f"{GRADED} SELECT method, {_GRADES}, CAST(list_position({_METHODS!r}, method) AS BIGINT) AS place FROM z GROUP BY method",
    "grade_per_fold_avg": f"{GRADED}, m AS (SELECT method, CAST(fold AS VARCHAR) AS fold, {_BARE} FROM z GROUP BY method, fold) SELECT method, fold, " + ", ".join(_r(k, k) for k in _RAW) + " FROM m UNION ALL SELECT method, 'Average', " + ", ".join(_r(f"avg({k})", k) for k in _RAW) + " FROM m GROUP BY method",
    "grade_by_subject": f"{GRADED} SELECT method, subject, {_GRADES} FROM z GROUP BY method, subject",
    "fusion_vs_min": f'{GRADED} SELECT {_r("corr(\"Choquet\", \"MinOfModels\")", "corr_min")}, {_r("avg(abs(\"Choquet\" - \"MinOfModels\"))", "gap_min")}, {_r("avg(abs(\"Choquet\" - \"PlainAverage\"))", "gap_mean")} FROM w',
    "verdict_vs_control": _verdict(),
    "best_single": f"{GRADED}, m AS (SELECT method, {_BARE} FROM z WHERE method IN ('LastReading', 'TrailingMean', 'PastMean') GROUP BY method) SELECT min_by(method, rmse) AS method, {_r('min(rmse)', 'rmse')} FROM m",
    "reliability_weighted": f"{PREDICTED}, l AS (" + " UNION ALL ".join(f"SELECT subject, ts, glucose, '{m}' AS method, \"{m}\" AS pred FROM p" for m in _MODELS) + f"), k AS (SELECT method, 1 / avg((pred - glucose) * (pred - glucose)) AS w FROM l GROUP BY method) SELECT subject, ts, {_r('sum(pred * w) / sum(w)', 'pred')} FROM l JOIN k USING (method) GROUP BY subject, ts, glucose",
    "protocol_comparison": _PROTOCOLS,
    "ablation": f"{GRADED}, a AS (" + " UNION ALL ".join(f"SELECT glucose, '{n}' AS method, {len(ms)} AS n_models, ({' + '.join(chr(34) + m + chr(34) for m in ms)}) / {len(ms)} AS pred FROM w" for n, ms in _ABLATE.items()) + f" UNION ALL SELECT glucose, 'NoSkillBaseline', 0, \"NoSkillBaseline\" FROM w), y AS (SELECT *, {zone_sql('glucose', 'pred')} AS zone FROM a) SELECT method, n_models, {_r(_RAW['r2'], 'r2')}, {_r(_RAW['zone_ab'], 'zone_ab')} FROM y GROUP BY method, n_models",
    "session_catalogue": f"{_PAIR} SELECT * FROM s_view UNION ALL SELECT * FROM s_click",
    "reading_in_session": f"{_PAIR} SELECT q.subject, q.ts, s.session_id, s.n FROM q JOIN s_view s ON s.subject = q.subject AND q.ts BETWEEN s.t_start AND s.t_end",
    "first_covering_session": f"{_PAIR}, s AS (SELECT * FROM s_view UNION ALL SELECT * FROM s_click) SELECT q.subject, q.ts, min(s.session_id) AS session_id FROM q JOIN s ON s.subject = q.subject AND q.ts BETWEEN s.t_start AND s.t_end GROUP BY 1, 2",
    "both_modalities": f"{_BOTH} SELECT subject, ts, {_r('glucose', 'glucose')}, first_session, second_session FROM m",
    "dropped_windows": f"{_BOTH}, k AS (SELECT subject, count(*) AS n FROM m GROUP BY subject) SELECT q.subject, count(*) AS candidates, coalesce(any_value(k.n), 0) AS kept, count(*) - coalesce(any_value(k.n), 0) AS dropped FROM q LEFT JOIN k ON k.subject = q.subject GROUP BY q.subject",
    "window_before": "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_type, row_number() OVER w - 1 AS end_idx, lag(value, 4) OVER w AS x0, lag(value, 3) OVER w AS x1, lag(value, 2) OVER w AS x2, lag(value) OVER w AS x3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT session_id, end_idx, " + ", ".join(_r(f"x{i}", f"x{i}") for i in range(4)) + " FROM e WHERE event_type = 'purchase' AND end_idx >= 4",
    "clock_zone_scores": f"{_CLOCK} SELECT subject, zone, matches FROM sc",
    "clock_zone_winner": f"""{_CLOCK}, k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY matches DESC, place) AS r FROM sc), t AS (SELECT subject, max(zone) FILTER (r = 1) AS zone, max(matches) FILTER (r = 1) AS best, max(matches) FILTER (r = 2) AS second FROM k GROUP BY subject)
      SELECT subject, CASE WHEN best >= 5 AND best >= 2 * greatest(second, 1) THEN zone END AS zone, best, second, best >= 5 AND best >= 2 * greatest(second, 1) AS decided FROM t""",
    "signal_usable": "SELECT vec_id, CASE WHEN len(embedding) = 0 THEN 'missing' WHEN CAST(list_max(embedding) AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE) < 0.5 THEN 'flat' END AS reason, CAST(len(embedding) AS INTEGER) AS n FROM embeddings",
    "decimated": f"WITH {_X} SELECT vec_id, CAST(i // 4 AS INTEGER) AS i, {_r('x', 'x')} FROM x WHERE i % 4 = 0",
    "last_samples": f"WITH {_X} SELECT vec_id, {_r('sum(x)', 'total')}, {_r('max(x)', 'hi')} FROM x WHERE i >= 48 GROUP BY vec_id",
    "signal_moments": f"WITH {_X}, {_MOMENTS} SELECT vec_id, {_r('kur', 'kur')}, {_r('ske', 'ske')} FROM m",
    "hjorth": f"WITH {_X}, {_HJORTH} SELECT vec_id, {_r('sm', 'sm')}, {_r('sc', 'sc')} FROM h",
    "amplitude_entropy": f"WITH {_X}, {_ENTROPY} SELECT vec_id, {_r('se', 'se')} FROM en",
    "window_features": f"WITH {_X}, {_MOMENTS}, {_HJORTH}, {_ENTROPY} SELECT m.vec_id, {', '.join(_r(c, c) for c in ('kur', 'ske', 'sm', 'sc', 'se'))} FROM m JOIN h ON h.vec_id = m.vec_id JOIN en ON en.vec_id = m.vec_id",
    "spectral_entropy": f"{_SPEC}, b AS (SELECT vec_id, CASE WHEN k = 0 THEN 0 ELSE p * n END AS p FROM g), q AS (SELECT vec_id, p / sum(p) OVER (PARTITION BY vec_id) AS q FROM b) SELECT vec_id, {_r('-sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / log2(33)', 'pse')} FROM q GROUP BY vec_id",
    "c0_complexity": f"{_SPEC}, q AS (SELECT *, sum(p * n) OVER (PARTITION BY vec_id) / 64 AS mean FROM g) SELECT vec_id, {_r('sum(CASE WHEN p > mean THEN 0 ELSE p * n END) / sum(p * n)', 'c0')} FROM q GROUP BY vec_id",
    "higuchi": f"""WITH {_X}, d AS (SELECT a.vec_id, k, a.i % k AS m, abs(a.x - b.x) AS d FROM x a, range(1, 11) t(k), x b WHERE b.vec_id = a.vec_id AND b.i = a.i - k),
      l AS (SELECT vec_id, k, m, sum(d) * 63 / (count(*) * k * k) AS l FROM d GROUP BY vec_id, k, m), q AS (SELECT vec_id, k, avg(l) AS l FROM l GROUP BY vec_id, k) SELECT vec_id, {_r('regr_slope(ln(l), ln(1.0::DOUBLE / k))', 'fd')} FROM q GROUP BY vec_id""",
    "sample_entropy": f"""WITH {_X}, {_EMBED}, t AS (SELECT vec_id, 0.2 * stddev_pop(x) AS r FROM x GROUP BY vec_id), q AS (SELECT p.vec_id, greatest(abs(p.a - o.a), abs(p.b - o.b)) AS d, greatest(abs(p.a - o.a), abs(p.b - o.b), abs(p.c - o.c)) AS d1, r FROM v p JOIN v o ON p.vec_id = o.vec_id AND p.i < o.i JOIN t ON t.vec_id = p.vec_id),
      n AS (SELECT vec_id, count(*) FILTER (d <= r) AS b, count(*) FILTER (d1 <= r) AS a FROM q GROUP BY vec_id) SELECT vec_id, {_r('CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) ELSE 0.0 END', 'ke')} FROM n""",
    "dwt_details": f"WITH {_X}, {_wave('x', _HIGH, 'h1')}, {_wave('x', _LOW, 'a1')}, b1 AS (SELECT vec_id, o AS i, x FROM a1), {_wave('b1', _HIGH, 'h2')} SELECT vec_id, 1 AS level, CAST(o AS INTEGER) AS o, {_r('x', 'x')} FROM h1 UNION ALL SELECT vec_id, 2, CAST(o AS INTEGER), round(x, 6) FROM h2",
    "moving_energy": f"WITH {_X}, e AS (SELECT vec_id, i, pow(x - coalesce(lag(x) OVER (PARTITION BY vec_id ORDER BY i), x), 2) AS energy FROM x) SELECT vec_id, CAST(i AS INTEGER) AS i, {_r('energy', 'energy')}, {_r('sum(energy) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7', 'smooth')} FROM e",
    "signal_peaks": f"{_PEAK} SELECT vec_id, CAST(i AS INTEGER) AS i, {_r('x', 'x')} FROM pk",
    "rr_hrv": f"""{_PEAK}, q AS (SELECT vec_id, CAST(lead(i) OVER (PARTITION BY vec_id ORDER BY i) - i AS BIGINT) AS rr, i FROM pk), d AS (SELECT *, lead(rr) OVER (PARTITION BY vec_id ORDER BY i) - rr AS d FROM q WHERE rr IS NOT NULL),
      sums AS (SELECT vec_id, count(*) AS n, CAST(sum(rr) AS BIGINT) AS t, CAST(sum(rr * rr) AS BIGINT) AS tt, CAST(sum(d * d) AS BIGINT) AS dd, CAST(count(*) FILTER (abs(d) > 3.2::DOUBLE) AS DOUBLE) AS far FROM d GROUP BY vec_id)
      SELECT vec_id, {_r('t / n / 64', 'rr_mean')}, {_r('60 * 64 * n / t', 'hr')}, CASE WHEN n >= 2 THEN round(sqrt(CAST(n * tt - t * t AS DOUBLE)) / n / 64, 6) END AS sdnn, CASE WHEN n >= 2 THEN round(sqrt(dd / (n - 1)) / 64, 6) END AS rmssd, CASE WHEN n >= 2 THEN round(far * 100 / (n - 1), 6) END AS pnn50 FROM sums""",
    "standardised": f"WITH {_FEATURES}, q AS (SELECT ship_month AS mo, " + ", ".join(f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()) AS z_{c}" for c in _NAMES[:5]) + " FROM f) SELECT " + _r("z_ship_month", "ship_month", 3) + ", count(*) AS n, " + ", ".join(_r(f"sum(z_{c})", c, 3) for c in _NAMES[:4]) + " FROM q GROUP BY mo, z_ship_month",
    "ufs_topk": f"WITH {_FEATURES}, c AS ({_CORR}), k AS (SELECT *, row_number() OVER (ORDER BY r * r / (1 - r * r) * (n - 2) DESC NULLS LAST, place) AS rank FROM c) SELECT feature, CAST(rank AS INTEGER) AS rank, {_r('r', 'r')} FROM k WHERE rank <= 5",
    "cross_means": f"WITH {_FEATURES.replace('f AS (SELECT', 'f0 AS (SELECT')}, ff AS (SELECT *, 1::DOUBLE AS one, {_fold(3)} AS fold FROM f0)" + " UNION ALL ".join(f" SELECT fold, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, {_r(f'sum({a} * {b}) / count(*)', 'mean')} FROM ff GROUP BY fold" for i, a in enumerate(["one", *_NAMES, "glucose"]) for j, b in enumerate(["one", *_NAMES, "glucose"]) if i <= j),
    "window_reasons": """WITH w AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, vec_id % 25 AS k FROM embeddings),
      o AS (SELECT k, CASE k WHEN 1 THEN x[1:40] WHEN 2 THEN list_transform(range(64), lambda i: 0.5::DOUBLE) WHEN 4 THEN NULL ELSE x END AS ecg, CASE k WHEN 5 THEN x[1:9] ELSE list_reverse(x) END AS ppg FROM w),
      j AS (SELECT *, CASE WHEN ecg IS NULL THEN 'ecg missing' WHEN len(ecg) < 48 THEN 'ecg too short' WHEN k = 3 THEN 'ecg not finite' WHEN list_max(ecg[-48:]) - list_min(ecg[-48:]) < 1e-9 THEN 'ecg flat' WHEN len(ppg) < 48 THEN 'ppg too short' ELSE 'kept' END AS reason FROM o)
      SELECT reason, count(*) AS n, round(sum(list_sum(ecg[-48:])) FILTER (reason = 'kept'), 4) AS ecg, round(sum(list_sum(ppg[-48:])) FILTER (reason = 'kept'), 4) AS ppg FROM j GROUP BY reason""",
    "sql_scalars": f"""WITH l AS (SELECT l_returnflag, l_quantity / 3.0::DOUBLE + 2 AS glucose, l_quantity / 4.0::DOUBLE + 40 * l_discount AS pred, l_discount + 0.05::DOUBLE AS a, l_tax + 0.1::DOUBLE AS b, l_quantity / 100.0::DOUBLE AS c FROM lineitem),
      z AS (SELECT *, {zone_sql('glucose', 'pred')} AS zone, {_lambda3('a', 'b', 'c')} AS lam FROM l)
      SELECT l_returnflag, {_r(_RAW['rmse'], 'rmse')}, {_r(_RAW['mard'], 'mard')}, {_r(_RAW['r2'], 'r2')}, {_r(_RAW['zone_a'], 'zone_a')}, {_r(_RAW['zone_ab'], 'zone_ab')}, max(zone) AS worst,
        {_r(f"avg({_choquet3(['glucose', 'pred', '10::DOUBLE'], ['a', 'b', 'c'], 'lam')})", 'fused', 4)}, {_r('avg(lam)', 'lam', 4)}, {_r('avg(a * pow(1 + lam * a, 2))', 'last_weight', 4)} FROM z GROUP BY l_returnflag""",
    "sql_window_features": f"WITH {_X}, {_MOMENTS}, {_HJORTH} SELECT m.vec_id AS key, {_r('kur', 'kur')}, {_r('ske', 'ske')}, {_r('sm', 'sm')} FROM m JOIN h ON h.vec_id = m.vec_id",
    "resume_pending": "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate < TIMESTAMP '1998-01-01')",
    "reject_reasons": "SELECT CASE WHEN value IS NULL THEN 'missing' WHEN value / 18.018::DOUBLE < 0.1 THEN 'too low' WHEN value / 18.018::DOUBLE > 25 THEN 'too high' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY 1",
    "feature_intersection": f"WITH {_FEATURES.replace('f AS (SELECT', 'f0 AS (SELECT')}, ff AS (SELECT *, {_fold(3)} AS fold FROM f0), c AS (" + " UNION ALL ".join(f"SELECT {k} AS k, '{c}' AS feature, {i} AS place, corr({c}, glucose) AS r FROM ff WHERE fold <> {k}" for k in range(3) for i, c in enumerate(_NAMES)) + "), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY r * r / (1 - r * r) DESC NULLS LAST, place) <= 5) SELECT feature, CAST(any_value(place) + 1 AS INTEGER) AS place FROM t GROUP BY feature HAVING count(*) = 3",
}


def _sweep() -> str:
    """Models smoothed along runs with three densities, fused with the raw models' densities, beside the raw ones."""
    parts, rows = [f"WITH RECURSIVE {_READ}, {_CAUSAL}, {_FOLDED}, {_DENSITY}", _runs("p", "u", _GAP, "*")], []
    grade = f"{_r('rmse', 'rmse', 4)}, {_r('mard', 'mard', 4)}"
    fused = _choquet3([f"v.{q}" for q in _Q], _G, "d.lam")
    for i, (name, g) in enumerate((("raw", None), ("1/7", "(1.0::DOUBLE / 7)"), ("0.20", "0.20::DOUBLE"), ("0.35", "0.35::DOUBLE"))):
        if g is None:
            source = "u"
        else:
            parts.append(_lams(g).replace("bis", f"bis{i}").replace("lams", f"lams{i}"))
            lists = ", ".join(f"list({q}) OVER t AS l{j}" for j, q in enumerate(_Q))
            smooth = ", ".join(f"CASE WHEN k = 1 THEN {q} ELSE list_sum(list_transform(list_reverse_sort(l{j}), lambda a, n: a * {g} * pow(1 + lam * {g}, n - 1))) END AS {q}" for j, q in enumerate(_Q))
            parts.append(f"w{i} AS (SELECT fold, glucose, {smooth} FROM (SELECT *, {lists} FROM u WINDOW t AS (PARTITION BY subject, run ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) q JOIN lams{i} ON k = len(l0))")
            source = f"w{i}"
        parts.append(f"g{i} AS (SELECT sqrt(avg((c - glucose) * (c - glucose))) AS rmse, avg(abs(c - glucose) / nullif(glucose, 0)) * 100 AS mard FROM (SELECT v.glucose, {fused} AS c FROM {source} v JOIN d ON d.fold = v.fold))")
        rows.append(f"SELECT '{name}' AS variant, {grade}, round(rmse - (SELECT rmse FROM g0), 4) AS delta FROM g{i}")
    return ", ".join(parts) + " " + " UNION ALL ".join(rows)


SQL["temporal_sweep"] = _sweep()
SQL["correlation_dim"] = f"""WITH {_X}, sd AS (SELECT vec_id, stddev_samp(x) AS sd, count(*) AS n FROM x GROUP BY vec_id),
  f AS (SELECT vec_id, i, x, lead(x) OVER (PARTITION BY vec_id ORDER BY i) AS y FROM x),
  q AS (SELECT a.vec_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM f a JOIN f b ON a.vec_id = b.vec_id AND a.i < b.i WHERE a.y IS NOT NULL AND b.y IS NOT NULL),
  c AS (SELECT q.vec_id, j, any_value(0.1::DOUBLE * pow(1.03::DOUBLE, j) * sd) AS r, count(*) * 2.0::DOUBLE / any_value((n - 1) * (n - 2)) AS c FROM q JOIN sd ON sd.vec_id = q.vec_id, range(0, 55) t(j) WHERE d < 0.1::DOUBLE * pow(1.03::DOUBLE, j) * sd GROUP BY q.vec_id, j)
  SELECT sd.vec_id, round(coalesce(k.cd, 0), 4) AS cd FROM sd LEFT JOIN (SELECT vec_id, CASE WHEN count(*) > 1 THEN regr_slope(ln(c), ln(r)) END AS cd FROM c GROUP BY vec_id) k ON k.vec_id = sd.vec_id"""

SQL["zone_vs_r2"] = f"{GRADED} SELECT method, {_r(_RAW['zone_ab'], 'zone_ab')}, {_r(_RAW['r2'], 'r2')} FROM z GROUP BY method"
SQL["headline"] = f"""{GRADED}, m AS (SELECT method, {_RAW['r2']} AS r2, {_RAW['rmse']} AS rmse FROM z GROUP BY method),
  k AS (SELECT *, CASE method WHEN 'Choquet' THEN 'fused' WHEN 'NoSkillBaseline' THEN 'control' END AS role FROM m WHERE method IN ('Choquet', 'NoSkillBaseline')
  UNION ALL SELECT *, 'best single' FROM (SELECT * FROM m WHERE method IN {tuple(_MODELS)!r} ORDER BY rmse, method LIMIT 1))
  SELECT role, method, {_r('r2', 'r2')}, {_r('rmse', 'rmse')} FROM k"""
SQL["fold_coverage"] = f"{PREDICTED} SELECT subject, count(DISTINCT fold) AS n_folds, count(*) AS n FROM p GROUP BY subject"
SQL["subject_coverage"] = f"{PREDICTED}, h AS (SELECT DISTINCT subject FROM p), q AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS subject FROM customer WHERE c_custkey IS NOT NULL) SELECT count(*) AS requested, count(h.subject) AS covered, count(*) = count(h.subject) AS complete FROM q LEFT JOIN h ON h.subject = q.subject"
SQL["finite_moments"] = f"SELECT event_type, count(value) AS n, {_r('avg(value)', 'mean')}, {_r('stddev_pop(value)', 'sd')} FROM events GROUP BY event_type"
