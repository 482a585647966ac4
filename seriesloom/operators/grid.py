"""What comes after a series: its step, its seasonal period and its future times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.numeric import ratio
from seriesloom.operators.profile import MAX_DISPERSION, detect_frequency
from seriesloom.operators.seasonality import CYCLE

# Steps the frequency bands leave out but a seasonal period or a calendar needs (seconds).
_EXTRA_STEPS = [(30, 90, "minute"), (7_689_600, 8_035_200, "quarterly"), (31_449_600, 31_708_800, "yearly")]
_MONTHS = {"monthly": 1, "quarterly": 3, "yearly": 12}


def step_name(frequency: Column, median_s: Column) -> Column:
    """The frequency, extended by minute, quarter and year; NULL where there is none."""
    out = F.when(frequency != "irregular", frequency)
    for lo, hi, name in _EXTRA_STEPS:
        out = F.coalesce(out, F.when(median_s.between(lo, hi), F.lit(name)))
    return out


def _business_days(panel: DataFrame) -> DataFrame:
    """``(series_id, business)``: a row on every day from Monday to Friday, none on others, over at least one weekend."""
    day = F.datediff(F.col("ts"), F.lit("1970-01-05"))  # a Monday
    place = lambda d: 5 * F.floor(d / 7) + F.pmod(d, F.lit(7))
    first, last = F.min(day), F.max(day)
    every = F.count(F.lit(1)) == place(last) - place(first) + 1
    gap = F.floor(last / 7) > F.floor(first / 7)
    return panel.groupBy("series_id").agg((every & gap & (F.max(F.pmod(day, F.lit(7))) <= 4)).alias("business"))


def steps_of(panel: DataFrame) -> DataFrame:
    """``(series_id, frequency, median_s, step, regular)``: how each series continues.

    A daily series without weekends continues on business days, which have no seasonal period.
    """
    freq = detect_frequency(panel).join(_business_days(panel.where(F.col("ts").isNotNull())), "series_id", "left")
    regular = F.coalesce(
        (F.col("median_s") > 0) & (ratio(F.col("mad_s"), F.col("median_s")) <= MAX_DISPERSION), F.lit(False)
    )
    return freq.select(
        "series_id",
        "frequency",
        "median_s",
        F.when(regular & F.coalesce("business", F.lit(False)) & (F.col("frequency") == "daily"), F.lit("business"))
        .when(regular, step_name(F.col("frequency"), F.col("median_s")))
        .alias("step"),
        regular.alias("regular"),
    )


def period_of(n: Column, step: Column, given: int | None = None) -> tuple[Column, Column]:
    """Seasonal period and whether it was dropped because the series is under two cycles."""
    if given is not None:
        wanted = F.lit(given)
    else:
        wanted = F.lit(None).cast("int")
        for name, cycle in CYCLE.items():
            if cycle > 1:
                wanted = F.when(step == name, F.lit(cycle)).otherwise(wanted)
    fell_back = F.coalesce(n < 2 * wanted, F.lit(False))
    return F.when(~fell_back, wanted).cast("int"), fell_back


def resolve_period(panel: DataFrame, given: int | None = None, steps: DataFrame | None = None) -> DataFrame:
    """``(series_id, n, period, fell_back)``: given, else from the step, else none."""
    sizes = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    steps = steps_of(panel) if steps is None else steps
    period, fell_back = period_of(F.col("n"), F.col("step"), given)
    return sizes.join(steps, "series_id").select(
        "series_id", "n", period.alias("period"), fell_back.alias("fell_back")
    )


def future_time(last: Column, step: Column, median_s: Column, h: Column) -> Column:
    """Time ``h`` steps after ``last``; months keep month ends, business days skip weekends, other steps are exact."""
    months = F.lit(None).cast("int")
    for name, size in _MONTHS.items():
        months = F.when(step == name, F.lit(size)).otherwise(months)
    day = last.cast("date")
    ahead = F.add_months(day, months * h)
    ahead = F.when(day == F.last_day(day), F.last_day(ahead)).otherwise(ahead)
    clock = F.unix_micros(last) - F.unix_micros(F.date_trunc("day", last))
    calendar = F.timestamp_micros(F.unix_micros(ahead.cast("timestamp")) + clock)
    exact = F.timestamp_micros(F.unix_micros(last) + F.round(median_s * F.lit(1e6)).cast("bigint") * h)
    weekends = F.floor((F.weekday(last) + h) / 5).cast("bigint")
    working = F.timestamp_micros(F.unix_micros(last) + F.lit(86_400_000_000) * (h + 2 * weekends))
    return F.when(months.isNotNull(), calendar).when(step == "business", working).otherwise(exact)


def horizons(panel: DataFrame, horizon: int | DataFrame) -> DataFrame:
    """``(series_id, horizon)`` from one number or a table."""
    if isinstance(horizon, DataFrame):
        return horizon.select("series_id", F.col("horizon").cast("int").alias("horizon"))
    return panel.select("series_id").distinct().withColumn("horizon", F.lit(horizon))


def future_grid(panel: DataFrame, horizon: int | DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """``(series_id, step_no, ts)`` for the next ``horizon`` steps of every regular series."""
    steps = steps_of(panel) if steps is None else steps
    last = panel.groupBy("series_id").agg(F.max("ts").alias("_last"))
    return (
        last.join(steps.where("regular"), "series_id")
        .join(horizons(panel, horizon).where(F.col("horizon") > 0), "series_id")
        .withColumn("step_no", F.explode(F.sequence(F.lit(1), F.col("horizon"))))
        .select(
            "series_id",
            "step_no",
            future_time(F.col("_last"), F.col("step"), F.col("median_s"), F.col("step_no")).alias("ts"),
        )
    )
