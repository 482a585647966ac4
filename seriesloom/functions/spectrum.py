"""Power spectrum of a series too long for one task.

Bluestein's algorithm turns a transform of any length n into a circular convolution of
length M = 2**q >= 2n. Its three transforms are split as M = N1 * N2 (Bailey's four-step
method): strided columns, a twiddle, then rows. Each step is one shuffle by series and
column or row, so a group holds about sqrt(M) points however long the series is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MID = "series_id string, n bigint, q int, k1 bigint, j2 bigint, ar double, ai double, br double, bi double"
_LAST = "series_id string, n bigint, q int, k1 bigint, j2 bigint, ar double, ai double"


def _sizes(q: int) -> tuple[int, int]:
    return 1 << (q - q // 2), 1 << (q // 2)


def _chirp(t: np.ndarray, n: int) -> np.ndarray:
    """exp(-i pi t**2 / n), reducing t**2 modulo 2n in integers first."""
    square = (t.astype(object) ** 2 % (2 * n)).astype(float) if t.max(initial=0) > 3_000_000_000 else t * t % (2 * n)
    return np.exp(-1j * np.pi * square / n)


def _columns(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    sid, j2 = key
    n, q = int(pdf["n"].iloc[0]), int(pdf["q"].iloc[0])
    n1, n2 = _sizes(q)
    total = n1 * n2
    a = np.zeros(n1, complex)
    pos = pdf["pos"].to_numpy(np.int64)
    a[pos // n2] = pdf["e"].to_numpy(float) * _chirp(pos, n)
    index = np.arange(n1, dtype=np.int64) * n2 + j2
    near = np.minimum(index, total - index)
    b = np.where(near < n, np.conj(_chirp(np.minimum(near, n), n)), 0)
    k1 = np.arange(n1)
    twiddle = np.exp(-2j * np.pi * (k1 * j2 % total) / total)
    fa, fb = np.fft.fft(a) * twiddle, np.fft.fft(b) * twiddle
    return pd.DataFrame(
        {"series_id": sid, "n": n, "q": q, "k1": k1, "j2": j2, "ar": fa.real, "ai": fa.imag, "br": fb.real, "bi": fb.imag}
    )


def _rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    sid, k1 = key
    n, q = int(pdf["n"].iloc[0]), int(pdf["q"].iloc[0])
    n1, n2 = _sizes(q)
    pdf = pdf.sort_values("j2")
    a = np.fft.fft(pdf["ar"].to_numpy() + 1j * pdf["ai"].to_numpy())
    b = np.fft.fft(pdf["br"].to_numpy() + 1j * pdf["bi"].to_numpy())
    j2 = np.arange(n2)
    c = np.fft.ifft(a * b) * np.exp(2j * np.pi * (k1 * j2 % (n1 * n2)) / (n1 * n2))
    return pd.DataFrame({"series_id": sid, "n": n, "q": q, "k1": k1, "j2": j2, "ar": c.real, "ai": c.imag})


def _finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    sid, j2 = key
    n, q = int(pdf["n"].iloc[0]), int(pdf["q"].iloc[0])
    n1, n2 = _sizes(q)
    pdf = pdf.sort_values("k1")
    c = np.fft.ifft(pdf["ar"].to_numpy() + 1j * pdf["ai"].to_numpy())
    k = np.arange(n1, dtype=np.int64) * n2 + j2
    keep = (k >= 1) & (k <= n // 2)
    return pd.DataFrame({"series_id": sid, "n": n, "k": k[keep], "power": np.abs(c[keep]) ** 2})


def long_spectrum(rows: DataFrame) -> DataFrame:
    """``(series_id, n, k, power)`` for bins 1..n/2 of ``e`` over positions 0..n-1."""
    sized = rows.withColumn("q", F.ceil(F.log2(2 * F.col("n"))).cast("int"))
    stride = F.expr("shiftleft(1L, q div 2)")
    return (
        sized.withColumn("j2", F.col("pos") % stride)
        .groupBy("series_id", "j2")
        .applyInPandas(_columns, _MID)
        .groupBy("series_id", "k1")
        .applyInPandas(_rows, _LAST)
        .groupBy("series_id", "j2")
        .applyInPandas(_finish, "series_id string, n bigint, k bigint, power double")
    )
