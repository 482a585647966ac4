import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from seriesloom.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def wave(n, base=0.0, slope=0.0, amp=0.0, period=7, sigma=1.0, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return base + slope * t + amp * np.sin(2 * np.pi * t / period) + rng.normal(0, sigma, n)


def make_panel(spark, series: dict, start="2022-01-01", freq="D"):
    """One panel from ``{series_id: values}``; NaN becomes missing."""
    frames = [
        pd.DataFrame({"series_id": k, "ts": pd.date_range(start, periods=len(v), freq=freq), "y": np.asarray(v, float)})
        for k, v in series.items()
    ]
    frame = pd.concat(frames, ignore_index=True).astype({"y": object})
    frame["y"] = frame["y"].where(frame["y"].notna(), None)
    return spark.createDataFrame(frame, "series_id string, ts timestamp, y double")


def blocked(panel, days=50):
    """The same panel, declared too long for one task: every ordered step goes by block."""
    from pyspark.sql import functions as F

    return panel.withColumn("block", F.floor(F.unix_seconds("ts") / F.lit(86_400 * days)))


@pytest.fixture
def small_pieces():
    """Pieces of 100 rows, so short fixtures have many of them."""
    from seriesloom.functions import order
    from seriesloom.operators import additive, anomaly, ets, seasonality, stationarity

    def cut(df, halo=0, size=100):
        return original(df, halo, size)

    original = order.pieces
    modules = (additive, anomaly, ets, seasonality, stationarity)
    for m in modules:
        m.pieces = cut
    saved = [(m, m.PIECE_ROWS) for m in modules if hasattr(m, "PIECE_ROWS")]
    for m, _ in saved:
        m.PIECE_ROWS = 100
    yield
    for m in modules:
        m.pieces = original
    for m, v in saved:
        m.PIECE_ROWS = v
