"""Order statistics on values that differ in their last bits, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.order import exact_quantile, order_statistics


def awkward(rng, n):
    """Random bit patterns (subnormals included), powers of two with both neighbours, zeros of both signs and infinities."""
    bits = rng.integers(0, 2**64, n, dtype=np.uint64).view(np.float64)
    powers = 2.0 ** rng.integers(-1074, 1024, n)
    near = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf)])
    close = 16 + rng.integers(-40, 40, n) * 2.0**-49
    tiny = rng.integers(1, 2**20, n) * 5e-324
    every = np.concatenate([bits[np.isfinite(bits)], near[np.isfinite(near)], close, tiny, [0.0, -0.0, np.inf, -np.inf, 2.0**31, np.nextafter(2.0**31, 0)]])
    return np.concatenate([every, -every[rng.random(len(every)) < 0.5]])


@pytest.mark.parametrize("seed", [0, 1])
def test_every_rank(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {"a": awkward(rng, 60), "b": np.array([np.nextafter(16, 0), 16.0, 17.0]), "c": np.nextafter(2.0 ** np.arange(-20, 40), 0)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = sorted({1, 2, 3, *rng.integers(1, len(groups["a"]), 12).tolist()})
    got = order_statistics(df, ["g"], "v", {f"r{k}": F.lit(k) for k in wanted}).collect()
    for r in got:
        ordered = np.sort(groups[r["g"]])
        for k in wanted:
            assert r[f"r{k}"] == (float(ordered[k - 1]) if k <= len(ordered) else None), (r["g"], k)


def test_quantile_of_neighbours(spark):
    values = np.concatenate([np.nextafter(1024.0, 0) * np.ones(3), [1024.0, 1025.0]])
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    assert exact_quantile(df, ["g"], "v", 0.5, "q").first()["q"] == np.nextafter(1024.0, 0)
