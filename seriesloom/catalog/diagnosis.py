"""Anomalies, stationarity, seasonality and the full diagnosis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.catalog.registry import (
    EVENTS_RAW, GAPPY, Tables, events_by, lineitem_by, ntz, numbered, orders_by, query, r,
)
from seriesloom.catalog.sources import frequency_sql
from seriesloom.functions.order import exact_quantile
from seriesloom.operators import anomaly as A
from seriesloom.operators import seasonality as S
from seriesloom.operators import stationarity as X
from seriesloom.operators.profile import detect_frequency
from seriesloom.plans.diagnosis import digest, digest_column, full_diagnosis
from seriesloom.sources.panel import compact, drop_missing, is_bounded

# -- anomalies -------------------------------------------------------------------------


def zscore_sql(panel: str) -> str:
    return f"""SELECT series_id, pos, y AS value, (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) AS z
FROM ({numbered(panel)}) WINDOW w AS (PARTITION BY series_id)"""


@query("zscores", f"SELECT series_id, pos, value, round(z, 6) AS z FROM ({zscore_sql(EVENTS_RAW)})")
def _(t: Tables):
    return A.zscores(t.events()).withColumn("z", r("z"))


@query(
    "zscore_anomalies",
    f"SELECT series_id, pos, value, round(z, 4) AS score FROM ({zscore_sql(EVENTS_RAW)}) WHERE abs(z) > 3",
)
def _(t: Tables):
    return A.zscore_anomalies(t.events())


@query(
    "zscore_anomalies_missing",
    f"SELECT series_id, pos, round(value, 4) AS value, round(z, 4) AS score FROM ({zscore_sql(GAPPY)}) WHERE abs(z) > 1.5",
)
def _(t: Tables):
    return A.zscore_anomalies(t.gappy(), 1.5).withColumn("value", r("value", 4))


@query(
    "contamination_threshold",
    f"""WITH s AS (SELECT series_id, pos, value, -abs(z) AS score FROM ({zscore_sql(EVENTS_RAW)})),
o AS (SELECT series_id, quantile_cont(score, 0.05) AS off FROM s GROUP BY 1)
SELECT series_id, pos, value, round(score - off, 4) AS score FROM s JOIN o USING (series_id) WHERE score < off""",
)
def _(t: Tables):
    scores = A.zscores(t.events()).select("series_id", "pos", "value", (-F.abs("z")).alias("score"))
    return A.flag_lowest(scores, bounded=True)


@query(
    "contamination_threshold_split",
    f"""WITH s AS (SELECT series_id, -abs(z) AS score FROM ({zscore_sql(EVENTS_RAW)}))
SELECT series_id, round(quantile_cont(score, 0.05), 6) AS threshold FROM s GROUP BY 1""",
)
def _(t: Tables):
    """The same quantile by the search that never brings one series into one task."""
    scores = A.zscores(t.events()).select("series_id", (-F.abs("z")).alias("score"))
    return exact_quantile(scores, ["series_id"], "score", 0.05, "threshold").withColumn("threshold", r("threshold"))


# Normal quantile by a rational approximation (Acklam, relative error 1e-9), for the weights.
_PROBIT = """CASE WHEN p < 0.02425 THEN (((((-7.784894002430293e-03*ql-3.223964580411365e-01)*ql-2.400758277161838e+00)*ql-2.549732539343734e+00)*ql+4.374664141464968e+00)*ql+2.938163982698783e+00)/((((7.784695709041462e-03*ql+3.224671290700398e-01)*ql+2.445134137142996e+00)*ql+3.754408661907416e+00)*ql+1)
WHEN p > 1 - 0.02425 THEN -(((((-7.784894002430293e-03*qh-3.223964580411365e-01)*qh-2.400758277161838e+00)*qh-2.549732539343734e+00)*qh+4.374664141464968e+00)*qh+2.938163982698783e+00)/((((7.784695709041462e-03*qh+3.224671290700398e-01)*qh+2.445134137142996e+00)*qh+3.754408661907416e+00)*qh+1)
ELSE (((((-3.969683028665376e+01*rr+2.209460984245205e+02)*rr-2.759285104469687e+02)*rr+1.383577518672690e+02)*rr-3.066479806614716e+01)*rr+2.506628277459239e+00)*q/(((((-5.447609879822406e+01*rr+1.615858368580409e+02)*rr-1.556989798598866e+02)*rr+6.680131188771972e+01)*rr-1.328068155288572e+01)*rr+1) END"""


def shapiro_sql(panel: str) -> str:
    """W and the method for series of 12 to 500 rows."""
    return f"""
WITH x AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY y) AS i,
  count(*) OVER (PARTITION BY series_id) AS n FROM ({panel}) WHERE y IS NOT NULL),
u AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM x),
v AS (SELECT *, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS rr, sqrt(-2 * ln(p)) AS ql, sqrt(-2 * ln(1 - p)) AS qh FROM u),
m AS (SELECT series_id, y, i, n, {_PROBIT} AS m FROM v),
t AS (SELECT series_id, n, sum(m * m) AS mm, max(m) AS m1, max(CASE WHEN i = n - 1 THEN m END) AS m2, 1 / sqrt(n) AS z FROM m GROUP BY 1, 2),
c AS (SELECT *, ((((-2.706056*z+4.434685)*z-2.071190)*z-0.147981)*z+0.221157)*z + m1 / sqrt(mm) AS a1,
  ((((-3.582633*z+5.682633)*z-1.752461)*z-0.293762)*z+0.042981)*z + m2 / sqrt(mm) AS a2 FROM t),
e AS (SELECT *, (mm - 2*m1*m1 - 2*m2*m2) / (1 - 2*a1*a1 - 2*a2*a2) AS eps FROM c),
w AS (SELECT series_id, m.n, pow(sum(CASE WHEN i = m.n THEN a1 WHEN i = m.n - 1 THEN a2 WHEN i = 2 THEN -a2 WHEN i = 1 THEN -a1
  ELSE m / sqrt(eps) END * y), 2) / (var_pop(y) * count(*)) AS w FROM m JOIN e USING (series_id) GROUP BY 1, 2)
SELECT series_id, n AS rows_tested, w, CASE WHEN (ln(1 - w) - (((0.0038915*ln(n)-0.083751)*ln(n)-0.31082)*ln(n)-1.5861))
  / exp((0.0030302*ln(n)-0.082676)*ln(n)-0.4803) < 1.6448536269514722 THEN 'zscore' ELSE 'isolation_forest' END AS method FROM w"""


for _name, _sql, _panel in (
    ("daily", events_by("day"), lambda t: t.events("day")),
    ("monthly", lineitem_by("month"), lambda t: t.lineitem()),
):

    @query(f"normality_{_name}", f"SELECT series_id, rows_tested, round(w, 6) AS w, method FROM ({shapiro_sql(_sql)})")
    def _(t: Tables, panel=_panel):
        return A.normality(panel(t)).select("series_id", "rows_tested", r("w").alias("w"), "method")


@query("normality_sampled")
def _(t: Tables):
    return A.normality(t.events()).select("series_id", "rows_tested", "w", "p", "method")


@query(
    "rollup_anomalies",
    f"""WITH a AS (SELECT series_id, pos, value, round(z, 4) AS score FROM ({zscore_sql(EVENTS_RAW)}) WHERE abs(z) > 3)
SELECT series_id, count(*) AS anomaly_count, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS anomaly_indices,
 string_agg(value::VARCHAR, ',' ORDER BY pos) AS anomaly_values FROM a GROUP BY 1""",
)
def _(t: Tables):
    rolled = A.rollup_anomalies(A.zscore_anomalies(t.events()))
    return rolled.select(
        "series_id", "anomaly_count", F.array_join("anomaly_indices", ",").alias("anomaly_indices"),
        F.array_join(F.col("details.value").cast("array<string>"), ",").alias("anomaly_values"),
    )


@query("isolation_forest_scores")
def _(t: Tables):
    return A.forest_scores(t.events())


@query(
    "forest_lookup",
    f"""WITH e AS ({numbered(EVENTS_RAW)}),
s AS (SELECT DISTINCT series_id, floor(y / 10) * 10 AS lo FROM e),
k AS (SELECT series_id, lo, -1.0 / (1 + row_number() OVER (PARTITION BY series_id ORDER BY lo)) AS score FROM s),
f AS (SELECT series_id, arg_min(score, lo) AS score FROM k GROUP BY 1)
SELECT e.series_id, pos, y AS value, round(coalesce(k.score, f.score), 9) AS score
FROM e ASOF LEFT JOIN k ON e.series_id = k.series_id AND e.y > k.lo JOIN f ON f.series_id = e.series_id""",
)
def _(t: Tables):
    """Scores of a step function with a step at every ten, looked up as those of a forest are."""
    panel = t.events()
    rows = drop_missing(A.positioned(panel))
    steps = rows.select("series_id", (F.floor(F.col("y") / 10) * 10.0).alias("lo")).distinct()
    number = F.row_number().over(Window.partitionBy("series_id").orderBy("lo"))
    steps = steps.withColumn("score", F.lit(-1.0) / (F.lit(1) + number))
    return A.look_up(rows, steps, is_bounded(panel)).withColumn("score", r("score", 9))


@query("isolation_forest_anomalies")
def _(t: Tables):
    return A.isolation_forest_anomalies(t.orders())


@query("detect_anomalies_auto")
def _(t: Tables):
    return A.detect_anomalies(t.events("day").unionByName(t.orders()))


@query(
    "detect_anomalies_zscore",
    f"SELECT series_id, pos, value, round(z, 4) AS score, 'zscore' AS method FROM ({zscore_sql(EVENTS_RAW)}) WHERE abs(z) > 3",
)
def _(t: Tables):
    return A.detect_anomalies(t.events(), "zscore")


# -- stationarity ----------------------------------------------------------------------

_SHORT_OR_FLAT = f"""
SELECT series_id, ts, y FROM ({orders_by('year')})
UNION ALL SELECT 'flat ' || series_id, ts, 1.0 FROM ({orders_by('day')})"""


@query(
    "stationarity_guards",
    f"""SELECT series_id, n >= 20 AS is_stationary, CASE WHEN n >= 20 THEN 0.0 END AS adf_pvalue,
 CASE WHEN n >= 20 THEN 1.0 END AS kpss_pvalue, 0 AS recommended_differencing,
 CASE WHEN n < 20 THEN 'series too short (' || n || ' obs, need ≥ 20)' ELSE 'constant series' END AS note
FROM (SELECT series_id, count(y) AS n FROM ({_SHORT_OR_FLAT}) GROUP BY 1)""",
)
def _(t: Tables):
    flat = t.orders().select(F.concat(F.lit("flat "), "series_id").alias("series_id"), "ts", F.lit(1.0).alias("y"))
    return X.check_stationarity(t.orders("year").unionByName(flat))


_DIFFERENCES = f"""
WITH p AS (SELECT series_id, ts, y, row_number() OVER w - 1 AS pos, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2
  FROM ({GAPPY}) WHERE y IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY ts, y))
SELECT series_id, 0 AS d, ts, pos, y FROM p
UNION ALL SELECT series_id, 1, ts, pos - 1, y - y1 FROM p WHERE pos >= 1
UNION ALL SELECT series_id, 2, ts, pos - 2, (y - y1) - (y1 - y2) FROM p WHERE pos >= 2"""


@query("differences", f"SELECT series_id, d, ts, pos, round(y, 4) AS y FROM ({_DIFFERENCES})")
def _(t: Tables):
    return X.differences(t.gappy()).select("series_id", "d", ntz("ts").alias("ts"), "pos", r("y", 4).alias("y"))


@query(
    "adf_fixed_lag",
    f"""WITH x AS (SELECT series_id, y, lag(y) OVER (PARTITION BY series_id ORDER BY ts, y) AS y1 FROM ({orders_by('day')})),
f AS (SELECT series_id, count(*) AS n, regr_slope(y - y1, y1) AS b, regr_syy(y - y1, y1) AS syy, regr_sxx(y - y1, y1) AS sxx
  FROM x WHERE y1 IS NOT NULL GROUP BY 1)
SELECT series_id, 0 AS lag, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 5) AS stat FROM f""",
)
def _(t: Tables):
    return X.adf(compact(t.orders()), max_lag=0).select("series_id", "lag", r("stat", 5).alias("stat"))


def adf_sql(panel: str) -> str:
    """Statistic by the smaller AIC of no lag and one lag; the regression on two variables is one of residuals."""
    return f"""
WITH x AS (SELECT series_id, pos, y - lag(y) OVER w AS d, lag(y) OVER w AS y1 FROM ({numbered(panel)}) WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
z AS (SELECT *, lag(d) OVER (PARTITION BY series_id ORDER BY pos) AS d1 FROM x),
zero AS (SELECT series_id, count(*) + 1 AS n, regr_slope(d, y1) AS b, regr_syy(d, y1) AS syy, regr_sxx(d, y1) AS sxx FROM z WHERE d IS NOT NULL GROUP BY 1),
one AS (SELECT series_id, count(*) AS m, regr_syy(d, y1) - regr_sxy(d, y1) ** 2 / regr_sxx(d, y1) AS ssr0,
  regr_syy(d, d1) - regr_sxy(d, d1) ** 2 / regr_sxx(d, d1) AS e00, regr_syy(y1, d1) - regr_sxy(y1, d1) ** 2 / regr_sxx(y1, d1) AS e11,
  regr_sxy(d, y1) - regr_sxy(d, d1) * regr_sxy(y1, d1) / regr_sxx(d, d1) AS e01 FROM z WHERE d1 IS NOT NULL GROUP BY 1),
j AS (SELECT *, m * ln((e00 - e01 * e01 / e11) / m) + 6 < m * ln(ssr0 / m) + 4 AS lagged FROM zero JOIN one USING (series_id))
SELECT series_id, lagged::INT AS lag, CASE WHEN lagged THEN e01 / e11 / sqrt((e00 - e01 * e01 / e11) / (n - 5) / e11)
  ELSE b / sqrt((syy - b * b * sxx) / (n - 3) / sxx) END AS stat FROM j"""


_DIFFERENCED = f"SELECT series_id || ':' || d AS series_id, ts, y FROM ({_DIFFERENCES})"


@query("adf_up_to_one_lag", f"SELECT series_id, lag, round(stat, 5) AS stat FROM ({adf_sql(_DIFFERENCED)})")
def _(t: Tables):
    """The series and both differences; the lag is chosen by AIC."""
    found = X.adf(X.differences(t.gappy()), ["series_id", "d"], max_lag=1)
    return found.select(F.concat_ws(":", "series_id", "d").alias("series_id"), "lag", r("stat", 5).alias("stat"))


@query("adf_by_aic")
def _(t: Tables):
    return X.adf(X.differences(t.orders()), ["series_id", "d"])


def kpss_sql(panel: str) -> str:
    return f"""
WITH b AS (SELECT series_id, pos, count(*) OVER w AS n, y - avg(y) OVER w AS e FROM ({numbered(panel)}) WINDOW w AS (PARTITION BY series_id)),
i AS (SELECT series_id, n, unnest(range(0, floor(pow(n, 2.0 / 9))::INT + 1)) AS lag FROM (SELECT DISTINCT series_id, n FROM b)),
f AS (SELECT i.series_id, i.n, i.lag, sum(a.e * c.e) AS s FROM i JOIN b a ON a.series_id = i.series_id
  JOIN b c ON c.series_id = a.series_id AND c.pos = a.pos - i.lag GROUP BY 1, 2, 3),
h AS (SELECT series_id, n, sum(CASE WHEN lag = 0 THEN s / n ELSE 2 * s / n END) AS s0, sum(CASE WHEN lag = 0 THEN 0 ELSE lag * 2 * s / n END) AS s1
  FROM f GROUP BY 1, 2),
k AS (SELECT series_id, n, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1)::INT AS lags FROM h),
j AS (SELECT series_id, unnest(range(0, lags + 1)) AS lag FROM k),
g AS (SELECT j.series_id, j.lag, sum(a.e * c.e) AS s FROM j JOIN b a ON a.series_id = j.series_id
  JOIN b c ON c.series_id = a.series_id AND c.pos = a.pos - j.lag GROUP BY 1, 2),
v AS (SELECT g.series_id, k.n, k.lags, sum(CASE WHEN lag = 0 THEN s ELSE 2 * (1 - lag / (k.lags + 1.0)) * s END) / k.n AS lrv
  FROM g JOIN k ON g.series_id = k.series_id WHERE lag <= k.lags GROUP BY 1, 2, 3),
c AS (SELECT series_id, sum(e) OVER (PARTITION BY series_id ORDER BY pos) AS s FROM b),
t AS (SELECT v.series_id, lags, sum(s * s) / (n::DOUBLE * n) / lrv AS stat FROM c JOIN v ON c.series_id = v.series_id GROUP BY v.series_id, lags, n, lrv)
SELECT series_id, lags, stat, CASE WHEN stat <= 0.347 THEN 0.10 WHEN stat < 0.463 THEN 0.10 + (stat - 0.347) * (0.05 - 0.10) / (0.463 - 0.347)
  WHEN stat < 0.574 THEN 0.05 + (stat - 0.463) * (0.025 - 0.05) / (0.574 - 0.463)
  WHEN stat < 0.739 THEN 0.025 + (stat - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END AS p FROM t"""


for _name, _sql, _panel in (
    ("orders_daily", orders_by("day"), lambda t: t.orders()),
    ("lineitem_monthly", lineitem_by("month"), lambda t: t.lineitem()),
):

    @query(f"kpss_{_name}", f"SELECT series_id, lags, round(stat, 6) AS stat, round(p, 6) AS p FROM ({kpss_sql(_sql)})")
    def _(t: Tables, panel=_panel):
        return X.kpss(compact(panel(t))).select("series_id", "lags", r("stat").alias("stat"), r("p").alias("p"))


@query(
    "gram",
    f"""SELECT series_id, i, j, round(v, 4) AS v FROM (SELECT series_id,
 unnest([0, 0, 0, 1, 1, 2]) AS i, unnest([0, 1, 2, 1, 2, 2]) AS j,
 unnest([sum(1.0), sum(pos / 1000.0), sum(y / 1e6), sum(pos / 1000.0 * (pos / 1000.0)), sum(pos / 1000.0 * (y / 1e6)), sum(y / 1e6 * (y / 1e6))]) AS v
 FROM ({numbered(orders_by('day'))}) GROUP BY 1)""",
)
def _(t: Tables):
    rows = compact(t.orders()).select(
        "series_id", F.lit(1.0).alias("one"), (F.col("pos") / 1000.0).alias("x"), (F.col("y") / 1e6).alias("v")
    )
    return X.gram(rows, ["series_id"], ["one", "x"], "v").withColumn("v", r("v", 4))


# Fixed value: the five-percent point of the statistic with a constant, for long series.
_ADF_FIVE_PERCENT = -2.8621


@query(
    "stationarity_verdict",
    f"""WITH k AS ({kpss_sql(_DIFFERENCED)}), a AS ({adf_sql(_DIFFERENCED)}),
j AS (SELECT split_part(series_id, ':', 1) AS series_id, split_part(series_id, ':', 2)::INT AS d,
  CASE WHEN a.stat < {_ADF_FIVE_PERCENT} THEN 0.01 ELSE 0.5 END AS adf_p, k.p AS kpss_p FROM k JOIN a USING (series_id)),
v AS (SELECT series_id, max(adf_p) FILTER (d = 0) AS adf_p, max(kpss_p) FILTER (d = 0) AS kpss_p,
  min(d) FILTER (adf_p < 0.05 AND kpss_p > 0.05) AS d FROM j GROUP BY 1)
SELECT series_id, coalesce(d = 0, false) AS is_stationary, adf_p AS adf_pvalue, round(kpss_p, 6) AS kpss_pvalue,
  coalesce(d, 2) AS recommended_differencing FROM v""",
)
def _(t: Tables):
    """The verdict from KPSS and ADF of the series and both differences, ADF by its five-percent point instead of a p-value."""
    panel, by = t.gappy(), ["series_id", "d"]
    rows = X.differences(panel)
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("y").alias("sd"))
    p = F.when(F.col("stat") < _ADF_FIVE_PERCENT, 0.01).otherwise(0.5)
    tests = size.join(X.adf(rows, by, max_lag=1).select(*by, p.alias("adf_p")), by)
    tests = tests.join(X.kpss(rows, by).select(*by, F.col("p").alias("kpss_p")), by)
    return X.verdict(tests, panel.groupBy("series_id").agg(F.count("y").alias("rows"))).drop("note")


@query("check_stationarity")
def _(t: Tables):
    return X.check_stationarity(t.orders().unionByName(t.lineitem()))


# -- seasonality -----------------------------------------------------------------------


def despike_sql(panel: str, threshold: float) -> str:
    return f"""
WITH z AS ({zscore_sql(panel)}),
p AS (SELECT n.series_id, n.ts, n.pos, CASE WHEN abs(z.z) > {threshold} THEN NULL ELSE n.y END AS y
  FROM ({numbered(panel)}) n LEFT JOIN z ON z.series_id = n.series_id AND z.pos = n.pos),
q AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0,
  first_value(y IGNORE NULLS) OVER a AS y1, first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1 FROM p
  WINDOW b AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, ts, pos, coalesce(y, y0 + (y1 - y0) * (pos - p0)::DOUBLE / nullif(p1 - p0, 0), y0, y1) AS y FROM q"""


@query("despike", f"SELECT series_id, pos, round(y, 7) AS y FROM ({despike_sql(GAPPY, 1.5)})")
def _(t: Tables):
    return S.despike(t.gappy(), A.zscore_anomalies(t.gappy(), 1.5)).select("series_id", "pos", r("y", 7).alias("y"))


def detrend_sql(panel: str) -> str:
    return f"""SELECT series_id, ts, pos, count(*) OVER w AS n,
 y - (regr_intercept(y, pos) OVER w + regr_slope(y, pos) OVER w * pos) AS e
FROM ({numbered(panel)}) WINDOW w AS (PARTITION BY series_id)"""


@query("detrend", f"SELECT series_id, pos, round(e, 3) AS e FROM ({detrend_sql(orders_by('day'))})")
def _(t: Tables):
    return S.detrend(t.orders()).select("series_id", "pos", r("e", 3).alias("e"))


def acf_sql(panel: str, limit: str) -> str:
    """``limit`` is a query for ``(series_id, top)``; the lag also stays below n/2 - 1."""
    return f"""
WITH e AS ({detrend_sql(panel)}),
l AS (SELECT DISTINCT e.series_id, e.n, unnest(range(0, least(top, e.n // 2 - 1) + 1)) AS lag
  FROM (SELECT DISTINCT series_id, n FROM e) e JOIN ({limit}) t ON t.series_id = e.series_id)
SELECT l.series_id, l.n, l.lag, sum(a.e * b.e) / (SELECT sum(z.e * z.e) FROM e z WHERE z.series_id = l.series_id) AS acf
FROM l JOIN e a ON a.series_id = l.series_id JOIN e b ON b.series_id = a.series_id AND b.pos = a.pos - l.lag GROUP BY 1, 2, 3"""


def _top(panel: str, top: int) -> str:
    return f"SELECT DISTINCT series_id, {top} AS top FROM ({panel})"


@query("acf", f"SELECT series_id, lag, round(acf, 6) AS acf FROM ({acf_sql(events_by('hour'), _top(events_by('hour'), 48))})")
def _(t: Tables):
    return S.acf(S.detrend(t.events("hour")), 48).withColumn("acf", r("acf"))


@query(
    "significant_lags",
    f"SELECT series_id, lag, round(acf, 6) AS acf FROM ({acf_sql(orders_by('day'), _top(orders_by('day'), 120))}) WHERE lag > 0 AND acf > 2 / sqrt(n)",
)
def _(t: Tables):
    rows = S.detrend(t.orders())
    size = rows.groupBy("series_id").agg(F.first("n").alias("n"))
    found = S.acf(rows, 120).join(size, "series_id")
    return found.where((F.col("lag") > 0) & (F.col("acf") > F.lit(S.BAND) / F.sqrt("n"))).select(
        "series_id", "lag", r("acf").alias("acf")
    )


def power_sql(panel: str) -> str:
    return f"""
WITH e AS ({detrend_sql(panel)}),
k AS (SELECT series_id, n, unnest(range(1, n // 2 + 1)) AS k FROM (SELECT DISTINCT series_id, n FROM e))
SELECT k.series_id, k.n, k.k, round_even(1.0::DOUBLE / (k.k * (1.0::DOUBLE / k.n)), 0)::INT AS period,
 pow(sum(e * cos(2 * pi() * ((k.k * pos) % k.n) / k.n)), 2) + pow(sum(e * sin(2 * pi() * ((k.k * pos) % k.n) / k.n)), 2) AS power
FROM k JOIN e ON e.series_id = k.series_id GROUP BY 1, 2, 3"""


_SCALED = "power / sum(power) OVER (PARTITION BY series_id)"


@query("power_spectrum", f"SELECT series_id, k, round({_SCALED}, 9) AS share FROM ({power_sql(orders_by('day'))})")
def _(t: Tables):
    rows = S.detrend(t.orders())
    total = S.total_power(rows).select("series_id", "total_power")
    return S.power(rows).join(total, "series_id").select("series_id", "k", r(F.col("power") / F.col("total_power"), 9).alias("share"))


@query(
    "power_per_period",
    f"SELECT series_id, period, count(*) AS bins, round(sum(s), 8) AS share FROM (SELECT *, {_SCALED} AS s FROM ({power_sql(events_by('hour'))})) GROUP BY 1, 2",
)
def _(t: Tables):
    rows = S.detrend(t.events("hour"))
    total = S.total_power(rows).select("series_id", "total_power")
    per = S.power(rows).groupBy("series_id", "period").agg(F.count(F.lit(1)).alias("bins"), F.sum("power").alias("power"))
    return per.join(total, "series_id").select(
        "series_id", "period", "bins", r(F.col("power") / F.col("total_power"), 8).alias("share")
    )


@query(
    "total_power",
    f"SELECT series_id, n, round(sum(power) / 1e9, 3) AS total_power FROM ({power_sql(orders_by('day'))}) GROUP BY 1, 2",
)
def _(t: Tables):
    return S.total_power(S.detrend(t.orders())).select("series_id", "n", r(F.col("total_power") / 1e9, 3).alias("total_power"))


_EXPECTED = "CASE frequency WHEN 'hourly' THEN 24 WHEN 'daily' THEN 7 WHEN 'weekly' THEN 52 WHEN 'monthly' THEN 12 ELSE 7 END"
_MIXED = f"""SELECT series_id || ' day' AS series_id, ts, y FROM ({orders_by('day')}) UNION ALL
SELECT series_id || ' month', ts, y FROM ({lineitem_by('month')}) UNION ALL SELECT series_id || ' week', ts, y FROM ({orders_by('week')})"""


def mixed(t: Tables):
    named = lambda p, s: p.withColumn("series_id", F.concat("series_id", F.lit(s)))
    return named(t.orders(), " day").unionByName(named(t.lineitem(), " month")).unionByName(named(t.orders("week"), " week"))


@query("expected_period", f"SELECT series_id, frequency, {_EXPECTED} AS expected_period FROM ({frequency_sql(_MIXED)})")
def _(t: Tables):
    found = detect_frequency(mixed(t))
    return found.select("series_id", "frequency", S.expected_period(F.col("frequency")).alias("expected_period"))


def seasonality_sql(panel: str) -> str:
    limit = f"SELECT series_id, 2 * {_EXPECTED} AS top FROM ({frequency_sql(panel)})"
    return f"""
WITH c AS (SELECT series_id, lag AS period FROM ({acf_sql(panel, limit)}) WHERE lag > 0 AND n >= 16 AND acf > 2 / sqrt(n)),
w AS (SELECT series_id, period, sum(power) AS power FROM ({power_sql(panel)}) GROUP BY 1, 2),
t AS (SELECT series_id, sum(power) AS total FROM w GROUP BY 1),
f AS (SELECT series_id, string_agg(period::VARCHAR, ',' ORDER BY period) AS detected_periods, arg_max(period, power) AS dominant_period, sum(power) AS found
  FROM w JOIN c USING (series_id, period) GROUP BY 1)
SELECT s.series_id, found IS NOT NULL AS has_seasonality, coalesce(detected_periods, '') AS detected_periods,
 coalesce(round(found / total, 4), 0) AS seasonality_strength, dominant_period
FROM (SELECT DISTINCT series_id FROM ({panel})) s LEFT JOIN f USING (series_id) LEFT JOIN t USING (series_id)"""


for _name, _sql, _panel in (
    ("orders_daily", orders_by("day"), lambda t: t.orders()),
    ("events_hourly", events_by("hour"), lambda t: t.events("hour")),
    ("lineitem_monthly", lineitem_by("month"), lambda t: t.lineitem()),
):

    @query(f"seasonality_{_name}", seasonality_sql(_sql))
    def _(t: Tables, panel=_panel):
        found = S.detect_seasonality(panel(t), detect_frequency(panel(t)))
        return found.withColumn("detected_periods", F.array_join("detected_periods", ","))


# -- full diagnosis --------------------------------------------------------------------


@query(
    "diagnosis_parts",
    f"""WITH a AS (SELECT series_id, count(*) AS anomaly_count FROM ({zscore_sql(lineitem_by('month'))}) WHERE abs(z) > 3 GROUP BY 1),
s AS ({seasonality_sql(f"SELECT series_id, ts, y FROM ({despike_sql(lineitem_by('month'), 3)})")}),
k AS ({kpss_sql(lineitem_by('month'))})
SELECT f.series_id, frequency, count(*) AS row_count, has_seasonality, detected_periods, seasonality_strength, dominant_period,
 round(p, 6) AS kpss_pvalue, coalesce(anomaly_count, 0) AS anomaly_count
FROM ({lineitem_by('month')}) m JOIN ({frequency_sql(lineitem_by('month'))}) f USING (series_id) JOIN s USING (series_id)
JOIN k USING (series_id) LEFT JOIN a USING (series_id) GROUP BY ALL""",
)
def _(t: Tables):
    d = full_diagnosis(t.lineitem(), method="zscore")
    return d.select(
        "series_id", F.col("profile.detected_frequency").alias("frequency"), "profile.row_count", "seasonality.has_seasonality",
        F.array_join("seasonality.detected_periods", ",").alias("detected_periods"), "seasonality.seasonality_strength",
        "seasonality.dominant_period", "stationarity.kpss_pvalue", "anomalies.anomaly_count",
    )


@query(
    "digest_short_series",
    f"""SELECT series_id, concat_ws(chr(10),
 'Dataset: ' || count(*) || ' rows, irregular frequency, ' || strftime(min(ts), '%b %Y') || ' to ' || strftime(max(ts), '%b %Y') || '.',
 'Target column: ''totalprice'' (mean: ' || printf('%.1f', avg(y)) || ', std: ' || printf('%.1f', stddev_samp(y)) || ').',
 'No missing values in target column.',
 'Stationarity test skipped (series too short (' || count(*) || ' obs, need ≥ 20)).',
 'No clear seasonality detected.', 'No anomalies detected.') AS summary
FROM ({orders_by('year')}) GROUP BY 1""",
)
def _(t: Tables):
    return digest(full_diagnosis(t.orders("year"), "totalprice", "zscore"))


@query("full_diagnosis")
def _(t: Tables):
    return full_diagnosis(t.orders().unionByName(t.lineitem())).withColumn("summary", digest_column())


@query("digest_daily")
def _(t: Tables):
    return digest(full_diagnosis(t.events("day")))
