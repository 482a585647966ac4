"""Forecasters by name, their cards, and which of them a series is long enough for."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.lineage import checkpoint
from seriesloom.functions.order import spread
from seriesloom.operators.additive import additive
from seriesloom.operators.conformal import Forecaster, conformal
from seriesloom.operators.ets import ets, failures, irregular_series
from seriesloom.operators.grid import future_grid, steps_of

MODELS: dict[str, Forecaster] = {"prophet": additive, "ets": ets}

# Sample floors and capabilities of the models.
FLOORS = {"prophet": 100, "ets": 24}
HANDLES_MISSING = {"prophet": True, "ets": False}

_TEXT = {
    "prophet": (
        "Piecewise-linear trend plus Fourier seasons, fitted as one regression per series.",
        "Trending series with a weekly or yearly cycle seen at least twice.",
    ),
    "ets": (
        "Exponential smoothing in state-space form with exact intervals for additive parts.",
        "Medium-length series with a steady trend and season and no other inputs.",
    ),
}


def register(
    name: str, forecaster: Forecaster, floor: int, handles_missing: bool, description: str = "", best_for: str = ""
) -> None:
    """Add a forecaster: a function ``(panel, horizon) -> forecast DataFrame``, such as :func:`per_series` makes."""
    MODELS[name] = forecaster
    FLOORS[name], HANDLES_MISSING[name] = floor, handles_missing
    _TEXT[name] = (description, best_for)


_BOUNDS = ("yhat", "lo80", "hi80", "lo95", "hi95")
_MADE = "series_id string, step_no int, " + ", ".join(f"{c} double" for c in _BOUNDS) + ", error string"


def per_series(name: str, kernel: Callable[[np.ndarray, int], pd.DataFrame]) -> Forecaster:
    """A forecaster from a function of one series: ``kernel(values in time order, horizon) -> DataFrame``.

    The frame has a row per step and the column ``yhat``, and may have ``lo80``, ``hi80``, ``lo95`` and ``hi95``. What the kernel
    raises for a series, and a frame without these rows, is that series' error row; all others are forecast. Missing values reach it as
    NaN. A series is one group, so it must fit a task.
    """

    def guarded(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        horizon = int(pdf["horizon"].iloc[0])
        try:
            found = pd.DataFrame(kernel(pdf.sort_values("ts")["y"].to_numpy(float), horizon)).reset_index(drop=True)
            if len(found) != horizon or "yhat" not in found:
                raise ValueError(f"the model gave {len(found)} steps of {horizon}, columns {sorted(map(str, found))}.")
            made = found.reindex(columns=list(_BOUNDS)).astype(float)
            return made.assign(series_id=key[0], step_no=np.arange(1, horizon + 1), error=None)[_ORDER]
        except Exception as problem:  # one series' failure is its own result, never the batch's
            row = dict.fromkeys(_ORDER) | {"series_id": key[0], "error": f"{type(problem).__name__}: {problem}"}
            return pd.DataFrame([row]).astype({c: float for c in _BOUNDS})

    def forecaster(panel: DataFrame, horizon: int | DataFrame) -> DataFrame:
        panel = checkpoint(panel)
        steps = checkpoint(steps_of(panel))
        grid = future_grid(panel, horizon, steps)
        longest = grid.groupBy("series_id").agg(F.max("step_no").alias("horizon"))
        asked = spread(panel.select("series_id", "ts", "y").join(longest, "series_id"), "series_id")
        # Read twice below, and the kernel may be expensive.
        made = checkpoint(asked.groupBy("series_id").applyInPandas(guarded, _MADE))
        bad = made.where(F.col("error").isNotNull()).select("series_id", "error").unionByName(irregular_series(steps))
        good = grid.join(made.where(F.col("error").isNull()), ["series_id", "step_no"]).select(
            "series_id",
            F.lit(name).alias("model_name"),
            "step_no",
            "ts",
            *_BOUNDS,
            F.lit(None).cast("map<string,string>").alias("metadata"),
            F.lit(None).cast("string").alias("error"),
        )
        return good.unionByName(failures(bad, name))

    return forecaster


_ORDER = ["series_id", "step_no", *_BOUNDS, "error"]


def build(name: str, conformal_intervals: bool = False) -> Forecaster:
    """The forecaster of that name, with conformal intervals if asked; KeyError if unknown."""
    if name not in MODELS:
        raise KeyError(name)
    return partial(conformal, MODELS[name]) if conformal_intervals else MODELS[name]


def floor_of(name: str, conformal_intervals: bool) -> int:
    """Usable observations needed; a conformal wrapper needs twice the base, and 50 at least."""
    return max(2 * FLOORS[name], 50) if conformal_intervals else FLOORS[name]


def model_cards(spark: SparkSession) -> DataFrame:
    """One row per model and per conformal wrapper; as small as the registry."""
    rows = []
    for name in MODELS:
        description, best_for = _TEXT[name]
        for wrapped in (False, True):
            rows.append(
                (
                    f"conformal({name})" if wrapped else name,
                    name,
                    wrapped,
                    f"Split-conformal intervals around {name}. {description}" if wrapped else description,
                    best_for,
                    HANDLES_MISSING[name],
                    floor_of(name, wrapped),
                    "conformal" if wrapped else "native",
                )
            )
    return spark.createDataFrame(
        rows,
        "name string, model_name string, conformal boolean, description string, best_for string, "
        "handles_missing boolean, min_samples_required int, supports_uncertainty string",
    )


def usable_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy("series_id").agg(F.count("y").alias("usable"))


def models_that_fit(usable: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """``(series_id, usable, fits)``: sorted names whose floor the usable rows reach.

    The cards are a handful of constants, so they become one array expression: no join.
    """
    if cards is None:
        floors = [(name, FLOORS[name]) for name in sorted(MODELS)]
    else:
        floors = sorted((r["name"], r["min_samples_required"]) for r in cards.collect())
    names = F.array(*[F.when(F.col("usable") >= f, F.lit(n)) for n, f in floors])
    return usable.select("series_id", "usable", F.array_compact(names).alias("fits"))
