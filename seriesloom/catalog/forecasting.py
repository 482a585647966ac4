"""Models, conformal intervals, requests and jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seriesloom.catalog.diagnosis import _MIXED, mixed
from seriesloom.catalog.registry import GAPPY, Tables, events_by, lineitem_by, ntz, numbered, orders_by, query, r
from seriesloom.catalog.sources import frequency_sql
from seriesloom.functions.lineage import shared_folder
from seriesloom.operators import additive as additive_model
from seriesloom.operators.additive import SEASONS, additive, additive_spec, gram_cells
from seriesloom.operators.conformal import (
    calibration_scores, conformal, conformal_quantile, split_panel, training_rows, unbounded_intervals,
)
from seriesloom.operators.ets import Z80, Z95, ets, fit_ets
from seriesloom.operators.grid import future_grid, resolve_period
from seriesloom.operators.registry import model_cards, models_that_fit, usable_counts
from seriesloom.plans.jobs import check_requests, job_by_id, jobs_by_status, run_forecast, run_jobs
from seriesloom.sources.panel import compact, is_bounded
from seriesloom.streaming.intake import finished_jobs, stream_jobs

ALPHA = 0.3


def smoothing(panel, horizon):
    """Simple exponential smoothing at a fixed parameter: a member of the family that SQL can state."""
    return ets(panel, horizon, trend=None, seasonal=None, damped=False, fixed={"alpha": ALPHA})


# -- grid and period -------------------------------------------------------------------

_WANTED = "CASE frequency WHEN 'hourly' THEN 24 WHEN 'daily' THEN 7 WHEN 'weekly' THEN 52 WHEN 'monthly' THEN 12 END"
_PERIODS = f"SELECT series_id, ts, y FROM ({_MIXED}) UNION ALL SELECT series_id || ' hour', ts, y FROM ({events_by('hour')})"


def _periods(t: Tables):
    hours = t.events("hour").withColumn("series_id", F.concat("series_id", F.lit(" hour")))
    return mixed(t).unionByName(hours.select("series_id", "ts", "y"))


@query(
    "resolve_period",
    f"""SELECT series_id, n, CASE WHEN n >= 2 * wanted THEN wanted END AS period, coalesce(n < 2 * wanted, false) AS fell_back
FROM (SELECT f.series_id, n, {_WANTED} AS wanted FROM ({frequency_sql(_PERIODS)}) f
JOIN (SELECT series_id, count(*) AS n FROM ({_PERIODS}) GROUP BY 1) c USING (series_id))""",
)
def _(t: Tables):
    return resolve_period(_periods(t))


@query(
    "resolve_period_given",
    f"""SELECT series_id, count(*) AS n, CASE WHEN count(*) >= 100 THEN 50 END AS period, count(*) < 100 AS fell_back
FROM ({_PERIODS}) GROUP BY 1""",
)
def _(t: Tables):
    return resolve_period(_periods(t), 50)


for _name, _sql, _step, _panel in (
    ("daily", orders_by("day"), "to_days(h::INT)", lambda t: t.orders()),
    ("hourly", events_by("hour"), "to_hours(h)", lambda t: t.events("hour")),
    ("monthly", lineitem_by("month"), "to_months(h::INT)", lambda t: t.lineitem()),
):

    @query(
        f"future_grid_{_name}",
        f"SELECT series_id, h::INT AS step_no, last + {_step} AS ts FROM (SELECT series_id, max(ts) AS last, unnest(range(1, 31)) AS h FROM ({_sql}) GROUP BY 1)",
    )
    def _(t: Tables, panel=_panel):
        return future_grid(panel(t), 30).select("series_id", "step_no", ntz("ts").alias("ts"))


@query(
    "future_grid_month_ends",
    f"""SELECT series_id, h::INT AS step_no, last_day((last + to_months(h::INT))::DATE)::TIMESTAMP AS ts
FROM (SELECT series_id, max(last_day(ts::DATE)) AS last, unnest(range(1, 13)) AS h FROM ({lineitem_by('month')}) GROUP BY 1)""",
)
def _(t: Tables):
    ends = t.lineitem().withColumn("ts", F.last_day("ts").cast("timestamp"))
    return future_grid(ends, 12).select("series_id", "step_no", ntz("ts").alias("ts"))


# -- exponential smoothing -------------------------------------------------------------


def smoothing_sql(panel: str) -> str:
    """Final level and error variance of the smoothing at ``ALPHA``, initial level by least squares."""
    return f"""
WITH p AS ({numbered(panel)}),
c AS (SELECT a.series_id, a.pos, a.y, coalesce(sum({ALPHA} * pow({1 - ALPHA}, a.pos - 1 - b.pos) * b.y), 0) AS c
  FROM p a LEFT JOIN p b ON b.series_id = a.series_id AND b.pos < a.pos GROUP BY 1, 2, 3),
s AS (SELECT series_id, count(*) AS n, sum((y - c) * pow({1 - ALPHA}, pos)) / sum(pow({1 - ALPHA}, 2 * pos)) AS l0 FROM c GROUP BY 1),
v AS (SELECT c.series_id, s.n, l0, sum(pow(y - c - pow({1 - ALPHA}, pos) * l0, 2)) / s.n AS sigma2 FROM c JOIN s ON s.series_id = c.series_id GROUP BY 1, 2, 3)
SELECT v.series_id, v.n, sigma2, pow({1 - ALPHA}, v.n) * l0 + sum({ALPHA} * pow({1 - ALPHA}, v.n - 1 - pos) * y) AS level
FROM v JOIN p ON p.series_id = v.series_id GROUP BY v.series_id, v.n, sigma2, l0"""


@query(
    "smoothing_fit",
    f"SELECT series_id, n, round(level, 4) AS level, round(sqrt(sigma2), 4) AS sigma FROM ({smoothing_sql(events_by('hour'))})",
)
def _(t: Tables):
    fit = fit_ets(t.events("hour"), trend=None, seasonal=None, damped=False, fixed={"alpha": ALPHA})
    return fit.select("series_id", "n", r("level", 4).alias("level"), r(F.sqrt("sigma2"), 4).alias("sigma"))


def smoothing_forecast_sql(panel: str, horizon: int, step: str) -> str:
    bounds = ", ".join(
        f"round(level {sign} {z} * sqrt(sigma2 * (1 + (h - 1) * {ALPHA * ALPHA})), 3) AS {name}"
        for name, sign, z in (("lo80", "-", Z80), ("hi80", "+", Z80), ("lo95", "-", Z95), ("hi95", "+", Z95))
    )
    return f"""SELECT series_id, h::INT AS step_no, last + {step} AS ts, round(level, 3) AS yhat, {bounds}
FROM ({smoothing_sql(panel)}) f JOIN (SELECT series_id, max(ts) AS last FROM ({panel}) GROUP BY 1) l USING (series_id),
 (SELECT unnest(range(1, {horizon + 1})) AS h)"""


def _forecast(df):
    return df.select("series_id", "step_no", ntz("ts").alias("ts"), *[r(c, 3).alias(c) for c in ("yhat", "lo80", "hi80", "lo95", "hi95")])


@query("smoothing_forecast", smoothing_forecast_sql(events_by("hour"), 24, "to_hours(h)"))
def _(t: Tables):
    return _forecast(smoothing(t.events("hour"), 24))


@query("ets_fit")
def _(t: Tables):
    return fit_ets(t.orders())


@query("ets_forecast_daily")
def _(t: Tables):
    return ets(t.orders(), 30)


@query("ets_forecast_multiplicative")
def _(t: Tables):
    return ets(t.lineitem(), 12, error="mul", seasonal="mul")


# -- additive model --------------------------------------------------------------------

_WEEK = [(f, i) for i in range(1, SEASONS["weekly"][1] + 1) for f in ("sin", "cos")]
_DAYS = "(epoch_us(ts) / 86400000000.0)"


def _additive_gram_sql() -> str:
    span = "(epoch_us(ts) - epoch_us(min(ts) OVER w)) / (epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w))::DOUBLE"
    columns = ["1.0", "t"] + [f"{f}(2 * pi() * {i} * d / 7)" for f, i in _WEEK] + ["y / 1e6"]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return f"""SELECT series_id, i, j, round(v, 4) AS v FROM (SELECT series_id, unnest({[i for i, _ in pairs]}) AS i, unnest({[j for _, j in pairs]}) AS j,
 unnest([{', '.join(f'sum({columns[i]} * ({columns[j]}))' for i, j in pairs)}]) AS v
 FROM (SELECT series_id, y, {span} AS t, {_DAYS} AS d FROM ({orders_by('day')}) WINDOW w AS (PARTITION BY series_id)) GROUP BY 1)"""


@query("additive_gram", _additive_gram_sql())
def _(t: Tables):
    """Gram matrices of the model's own design (weekly season, no changepoints), piece by piece as for long series."""
    rows = compact(t.orders())
    spec = additive_spec(rows, False, True, False, 0)
    keyed = rows.select("series_id", "pos", F.unix_micros("ts").alias("micros"), "y").join(spec, "series_id")
    cells = gram_cells(keyed).join(spec.select("series_id", "scale"), "series_id")
    # The design begins with time and constant and ends with the scaled value; the SQL has the constant first, millions last.
    swap = lambda c: F.when(F.col(c) < 2, 1 - F.col(c)).otherwise(F.col(c))
    last = 2 + len(_WEEK)
    times = F.when(F.col("i") == last, 1).otherwise(0) + F.when(F.col("j") == last, 1).otherwise(0)
    value = F.col("v") * F.pow(F.col("scale") / F.lit(1e6), times)
    placed = cells.select("series_id", F.least(swap("i"), swap("j")).alias("i"), F.greatest(swap("i"), swap("j")).alias("j"), value.alias("v"))
    return placed.withColumn("v", r("v", 4))


def line_sql(panel: str) -> str:
    """Posterior mode of the additive model without seasons and rate changes, by its own iteration."""
    p, h2 = 1 / additive_model.TREND_SCALE**2, additive_model.NOISE_SCALE**2
    return f"""
WITH RECURSIVE m AS (SELECT series_id, epoch_us(ts) AS u, y FROM ({panel}) WHERE y IS NOT NULL),
b AS (SELECT series_id, min(u) AS start, max(u) AS stop, max(abs(y)) AS scale, count(*) AS n FROM m GROUP BY 1),
x AS (SELECT series_id, n, start, stop, scale, (u - start) / (stop - start)::DOUBLE AS t, y / scale AS v FROM m JOIN b USING (series_id)),
g AS (SELECT series_id, n, start, stop, scale, sum(t * t) AS tt, sum(t) AS t, sum(t * v) AS tv, sum(v) AS v, sum(v * v) AS vv FROM x GROUP BY ALL),
i AS (
  SELECT series_id, 0 AS turn, greatest(vv / n, 1e-12) AS noise, 0.0::DOUBLE AS k, 0.0::DOUBLE AS m FROM g
  UNION ALL
  SELECT series_id, turn + 1, greatest(2 * left_ / (n + sqrt(n::DOUBLE * n + 4 * left_ / {h2})), 1e-12), k, m
  FROM (SELECT *, greatest(vv - 2 * (k * tv + m * v) + k * k * tt + 2 * k * m * t + m * m * n, 0.0) AS left_
        FROM (SELECT g.*, turn, (tv * (n + {p} * noise) - t * v) / ((tt + {p} * noise) * (n + {p} * noise) - t * t) AS k,
                     ((tt + {p} * noise) * v - t * tv) / ((tt + {p} * noise) * (n + {p} * noise) - t * t) AS m
              FROM i JOIN g USING (series_id) WHERE turn < 60) AS solved) AS residual)
SELECT series_id, n, start, stop, i.k * scale AS k, i.m * scale AS m, sqrt(noise) * scale AS sigma FROM i JOIN g USING (series_id) WHERE turn = 60"""


@query("additive_line_fit", f"SELECT series_id, n, round(k, 2) AS k, round(m, 2) AS m, round(sigma, 2) AS sigma FROM ({line_sql(GAPPY)})")
def _(t: Tables):
    panel = t.gappy()
    rows = compact(panel)
    spec = additive_model.additive_spec(rows, False, False, False, 0)
    fit = additive_model.fit_additive(rows, spec, additive_model.CHANGEPOINT_SCALE, is_bounded(panel))
    return fit.select("series_id", "n", r("k", 2).alias("k"), r("m", 2).alias("m"), r("sigma", 2).alias("sigma"))


@query(
    "additive_line_forecast",
    f"""WITH f AS ({line_sql(lineitem_by('month'))}),
g AS (SELECT *, unnest(range(1, 7))::INT AS step_no FROM f),
h AS (SELECT *, make_timestamp(stop) + to_months(step_no) AS ts FROM g),
y AS (SELECT *, k * ((epoch_us(ts) - start) / (stop - start)::DOUBLE) + m AS yhat FROM h)
SELECT series_id, step_no, ts, round(yhat, 2) AS yhat, round(yhat - {Z80} * sigma, 2) AS lo80, round(yhat + {Z80} * sigma, 2) AS hi80,
 round(yhat - {Z95} * sigma, 2) AS lo95, round(yhat + {Z95} * sigma, 2) AS hi95 FROM y""",
)
def _(t: Tables):
    found = additive_model.additive(t.lineitem(), 6, False, False, False, n_changepoints=0)
    bounds = [r(c, 2).alias(c) for c in ("yhat", "lo80", "hi80", "lo95", "hi95")]
    return found.select("series_id", "step_no", ntz("ts").alias("ts"), *bounds)


@query("additive_forecast")
def _(t: Tables):
    return additive(t.orders(), 30)


@query("additive_forecast_hourly")
def _(t: Tables):
    return additive(t.events("hour"), 48)


# -- conformal -------------------------------------------------------------------------


@query(
    "conformal_split",
    f"SELECT series_id, count(*) AS n, 7 * count(*) // 10 AS n_train, count(*) - 7 * count(*) // 10 AS n_cal FROM ({_MIXED}) GROUP BY 1",
)
def _(t: Tables):
    n = F.count(F.lit(1))
    sizes = mixed(t).groupBy("series_id").agg(n.alias("n"), training_rows(n).alias("n_train"))
    return sizes.withColumn("n_cal", F.col("n") - F.col("n_train"))


def scores_sql(panel: str) -> str:
    cut = f"SELECT series_id, ts, y FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ({numbered(panel)})) WHERE pos < 7 * n // 10"
    return f"""
WITH a AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ({numbered(panel)})),
f AS ({smoothing_sql(cut)})
SELECT a.series_id, (a.pos - 7 * a.n // 10 + 1)::INT AS step_no, abs(a.y - f.level) AS score
FROM a JOIN f ON f.series_id = a.series_id WHERE a.pos >= 7 * a.n // 10 AND a.y IS NOT NULL"""


@query("conformal_scores", f"SELECT series_id, step_no, round(score, 4) AS score FROM ({scores_sql(events_by('hour'))})")
def _(t: Tables):
    sized, both = split_panel(t.events("hour"))
    back = sized.groupBy("series_id").agg((F.first("n") - F.first("n_train")).alias("horizon"))
    train = both.where(F.col("series_id").startswith("t")).withColumn("series_id", F.expr("substring(series_id, 2)"))
    return calibration_scores(sized, smoothing(train, back)).withColumn("score", r("score", 4))


def quantile_sql(scores: str) -> str:
    return f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score) AS k, count(*) OVER (PARTITION BY series_id) AS n FROM ({scores}))
SELECT series_id, n AS n_calibration, coalesce(max(CASE WHEN k = ceil(0.8 * (n + 1)) THEN score END), 'Infinity'::DOUBLE) AS q80,
 coalesce(max(CASE WHEN k = ceil(0.95 * (n + 1)) THEN score END), 'Infinity'::DOUBLE) AS q95 FROM k GROUP BY 1, 2"""


_SCORES = """SELECT event_type AS series_id, value AS score FROM events
UNION ALL SELECT r_name, n_nationkey::DOUBLE FROM nation JOIN region ON n_regionkey = r_regionkey"""


def _scores(t: Tables):
    nations = t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.table("events").select(F.col("event_type").alias("series_id"), F.col("value").alias("score")).unionByName(
        nations.select(F.col("r_name").alias("series_id"), F.col("n_nationkey").cast("double").alias("score"))
    )


for _name, _bounded in (("", True), ("_split", False)):

    @query(f"conformal_quantile{_name}", quantile_sql(_SCORES))
    def _(t: Tables, bounded=_bounded):
        return conformal_quantile(_scores(t), ["series_id"], {"q80": 0.20, "q95": 0.05}, bounded=bounded)


_APPLIED = f"""
WITH q AS ({quantile_sql(scores_sql(events_by('hour')))}), f AS ({smoothing_sql(events_by('hour'))})
SELECT series_id, h::INT AS step_no, last + to_hours(h) AS ts, round(level, 3) AS yhat, round(level - q80, 3) AS lo80, round(level + q80, 3) AS hi80,
 round(level - q95, 3) AS lo95, round(level + q95, 3) AS hi95
FROM q JOIN f USING (series_id) JOIN (SELECT series_id, max(ts) AS last FROM ({events_by('hour')}) GROUP BY 1) l USING (series_id), (SELECT unnest(range(1, 13)) AS h)"""


@query("conformal_apply", _APPLIED)
def _(t: Tables):
    return _forecast(conformal(smoothing, t.events("hour"), 12))


@query("conformal_ets")
def _(t: Tables):
    return conformal(ets, t.lineitem(), 12)


_SHORT_AND_LONG = f"SELECT series_id, ts, y FROM ({events_by('day')}) UNION ALL SELECT series_id, ts, y FROM ({orders_by('day')})"


@query(
    "unbounded_intervals",
    f"""SELECT series_id, 'conformal(ets)' AS model_name, ceil(0.95 * (n - 7 * n // 10 + 1)) > n - 7 * n // 10 AS unbounded
FROM (SELECT series_id, count(*) AS n FROM ({_SHORT_AND_LONG}) GROUP BY 1)""",
)
def _(t: Tables):
    return unbounded_intervals(conformal(smoothing, t.events("day").unionByName(t.orders()), 5))


# -- models and requests ---------------------------------------------------------------

_CARDS = """SELECT * FROM (VALUES ('prophet', 100, true, 'native'), ('conformal(prophet)', 200, true, 'conformal'),
 ('ets', 24, false, 'native'), ('conformal(ets)', 50, false, 'conformal')) c(name, min_samples_required, handles_missing, supports_uncertainty)"""
_USABLE = f"SELECT series_id, count(y) AS usable FROM ({_SHORT_AND_LONG} UNION ALL SELECT series_id, ts, y FROM ({lineitem_by('month')}) UNION ALL SELECT series_id || ' year', ts, y FROM ({orders_by('year')})) GROUP BY 1"


def _usable(t: Tables):
    years = t.orders("year").withColumn("series_id", F.concat("series_id", F.lit(" year")))
    return t.events("day").unionByName(t.orders()).unionByName(t.lineitem()).unionByName(years)


@query(
    "model_cards",
    f"SELECT c.*, (SELECT count(*) FROM ({_USABLE}) WHERE usable >= min_samples_required) AS series_long_enough FROM ({_CARDS}) c",
)
def _(t: Tables):
    cards = model_cards(t.spark).select("name", "min_samples_required", "handles_missing", "supports_uncertainty")
    usable = usable_counts(_usable(t))
    fitting = models_that_fit(usable, model_cards(t.spark)).select(F.explode("fits").alias("name")).groupBy("name").count()
    return cards.join(fitting, "name", "left").select(
        "name", "min_samples_required", "handles_missing", "supports_uncertainty",
        F.coalesce("count", F.lit(0)).alias("series_long_enough"),
    )


@query(
    "models_that_fit",
    f"""SELECT series_id, usable, CASE WHEN usable >= 100 THEN 'ets,prophet' WHEN usable >= 24 THEN 'ets' ELSE '' END AS fits FROM ({_USABLE})""",
)
def _(t: Tables):
    return models_that_fit(usable_counts(_usable(t))).withColumn("fits", F.array_join("fits", ","))


_REQUESTS = f"""SELECT series_id || '/' || m || '/' || h AS job_id, series_id, m AS model_name, h AS horizon, m = 'ets' AND h = 14 AS conformal, usable
FROM ({_USABLE}), (VALUES ('prophet', 7), ('ets', 14), ('ets', 7), ('arima', 7), ('ets', 0), ('ets', 1001)) v(m, h)"""


def requests(t: Tables, panel):
    """Six requests per series: two models, a conformal one, an unknown model and two bad horizons."""
    kinds = [("prophet", 7), ("ets", 14), ("ets", 7), ("arima", 7), ("ets", 0), ("ets", 1001)]
    variants = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(h).alias("h")) for m, h in kinds]))
    ids = panel.select("series_id").distinct().select("series_id", variants.alias("v"))
    return ids.select(
        F.concat_ws("/", "series_id", "v.m", F.col("v.h").cast("string")).alias("job_id"),
        "series_id",
        F.col("v.m").alias("model_name"),
        F.col("v.h").alias("horizon"),
        ((F.col("v.m") == "ets") & (F.col("v.h") == 14)).alias("conformal"),
    )


_LABEL = "CASE WHEN conformal THEN 'conformal(' || model_name || ')' ELSE model_name END"
_FLOOR = "CASE model_name WHEN 'prophet' THEN CASE WHEN conformal THEN 200 ELSE 100 END ELSE CASE WHEN conformal THEN 50 ELSE 24 END END"
_CHECKED = f"""SELECT job_id, series_id, model_name, horizon, conformal, usable, CASE
 WHEN model_name NOT IN ('prophet', 'ets') THEN 'ValueError: Unknown model ''' || model_name || '''. Available: prophet, ets.'
 WHEN horizon < 1 OR horizon > 1000 THEN 'ValueError: horizon must be between 1 and 1000.'
 WHEN usable < {_FLOOR} THEN 'ValueError: ' || {_LABEL} || ' needs at least ' || {_FLOOR} || ' usable observations and this series has ' || usable || '. '
  || CASE WHEN usable >= 100 THEN 'Models that fit: ets, prophet.' WHEN usable >= 24 THEN 'Models that fit: ets.' ELSE 'No model fits.' END
 END AS error FROM ({_REQUESTS})"""


@query("check_requests", _CHECKED)
def _(t: Tables):
    panel = _usable(t)
    return check_requests(requests(t, panel), panel).drop("created_at", "label", "target_column")


_JOBS = f"SELECT job_id, series_id, model_name, horizon, conformal, usable, CASE WHEN error IS NULL THEN 'done' ELSE 'failed' END AS status, error FROM ({_CHECKED})"


def _jobs(t: Tables):
    panel = _usable(t)
    return run_jobs(requests(t, panel), panel)


@query("run_jobs", _JOBS)
def _(t: Tables):
    return _jobs(t).jobs.drop("created_at", "started_at", "finished_at", "target_column")


@query("job_status_counts", f"SELECT status, model_name, count(*) AS jobs FROM ({_JOBS}) GROUP BY 1, 2")
def _(t: Tables):
    return _jobs(t).jobs.groupBy("status", "model_name").agg(F.count(F.lit(1)).alias("jobs"))


@query("job_forecasts", f"SELECT job_id, count(*) AS steps, max(horizon)::INT AS last_step FROM (SELECT *, unnest(range(horizon)) FROM ({_JOBS}) WHERE status = 'done') GROUP BY 1")
def _(t: Tables):
    return _jobs(t).forecasts.groupBy("job_id").agg(F.count(F.lit(1)).alias("steps"), F.max("step_no").alias("last_step"))


def _written_jobs(t: Tables):
    panel = _usable(t)
    path = f"{shared_folder(t.spark)}/jobs-{uuid.uuid4()}"
    checked = check_requests(requests(t, panel), panel).withColumn(
        "status", F.when(F.col("error").isNull(), "done").otherwise("failed")
    )
    checked.drop("created_at", "label", "target_column").write.partitionBy("status").parquet(path)
    return t.spark.read.parquet(path)


@query("jobs_by_status", f"SELECT * FROM ({_JOBS}) WHERE status = 'failed'")
def _(t: Tables):
    return jobs_by_status(_written_jobs(t), "failed")


@query("job_by_id", f"SELECT * FROM ({_JOBS}) WHERE job_id = (SELECT max(job_id) FROM ({_JOBS}))")
def _(t: Tables):
    jobs = _written_jobs(t)
    return job_by_id(jobs, jobs.agg(F.max("job_id")).first()[0])


@query("stream_jobs", f"SELECT job_id, series_id, model_name, horizon, conformal, usable, status, error FROM ({_JOBS})")
def _(t: Tables):
    """The same requests, written as files and taken in by a stream."""
    panel = _usable(t)
    base = f"{shared_folder(t.spark)}/stream-{uuid.uuid4()}"
    requests(t, panel).write.json(f"{base}/requests")
    stream_jobs(t.spark, f"{base}/requests", panel, f"{base}/checkpoint", f"{base}/out").awaitTermination()
    return finished_jobs(t.spark, f"{base}/out").select(
        "job_id", "series_id", "model_name", "horizon", "conformal", "usable", "status", "error"
    )


@query(
    "run_forecast_digests",
    f"""SELECT f.series_id AS job_id, 'ets' AS model_name, 'done' AS status, 12 AS horizon,
 'Dataset: ' || count(*) || ' rows, ' || frequency || ' frequency, ' || strftime(min(ts), '%b %Y') || ' to ' || strftime(max(ts), '%b %Y') || '.' AS dataset,
 'Target column: ''y'' (mean: ' || printf('%.1f', avg(y)) || ', std: ' || printf('%.1f', stddev_samp(y)) || ').' AS target,
 'No missing values in target column.' AS missing
FROM ({lineitem_by('month')}) m JOIN ({frequency_sql(lineitem_by('month'))}) f ON f.series_id = m.series_id GROUP BY f.series_id, frequency""",
)
def _(t: Tables):
    """The jobs of a batch, with what the digest of each job's series says of its rows."""
    panel = t.lineitem()
    wanted = panel.select("series_id").distinct().select(
        F.col("series_id").alias("job_id"), "series_id", F.lit("ets").alias("model_name"), F.lit(12).alias("horizon")
    )
    lines = [F.split("summary", "\n")[i].alias(name) for i, name in enumerate(("dataset", "target", "missing"))]
    return run_forecast(panel, wanted).jobs.select("job_id", "model_name", "status", "horizon", *lines)


@query("run_forecast")
def _(t: Tables):
    panel = t.lineitem()
    wanted = panel.select("series_id").distinct().select(
        F.col("series_id").alias("job_id"), "series_id", F.lit("ets").alias("model_name"), F.lit(12).alias("horizon")
    )
    return run_forecast(panel, wanted).jobs.drop("created_at", "started_at", "finished_at")
