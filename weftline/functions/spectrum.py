"""Spectral period of short windows, worked out for a whole Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def batch_periods(x: np.ndarray) -> np.ndarray:
    """Period of the fastest of the three strongest spectral peaks of each row.

    A peak is a local maximum of the power spectrum inside its ends that is
    more than twice the median power of the bins that are no peak.  NaN where
    there is none.
    """
    n = x.shape[1]
    x = (x - x.mean(axis=1, keepdims=True)) * np.hamming(n)
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    power = power[:, 1 : (n + 1) // 2]
    peak = np.zeros(power.shape, dtype=bool)
    mid = power[:, 1:-1]
    peak[:, 1:-1] = (mid > power[:, :-2]) & (mid > power[:, 2:])
    noise = np.nanmedian(np.where(peak, np.nan, power), axis=1, keepdims=True)
    strong = peak & (power > 2 * noise)
    height = np.where(strong, power, -1.0)
    third = np.sort(height, axis=1)[:, -3:][:, :1]
    kept = strong & (height >= third)
    fastest = power.shape[1] - np.argmax(kept[:, ::-1], axis=1)
    period = n / fastest
    good = kept.any(axis=1) & (period >= 2) & (period <= n)
    return np.where(good, period, np.nan)


def dominant_period(n: int) -> Callable[[Column, Column, Column], Column]:
    """Column function (value, value of the row before, whether a part starts here) to the period of the ``n`` values
    before the row; null where there are fewer or one is missing.

    A row crosses to Python as its own values, not as its window: the function keeps the last ``n`` values between
    Arrow batches and lays a sliding view over them.  So it belongs right after the window that gives the other two
    arguments, whose order it relies on, and the row before is compared to make sure of that.  It is declared
    nondeterministic so that no filter moves below it.
    """

    @F.pandas_udf("double")
    def period(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held, run = np.zeros(n), 0  # the last values, and how many before the next row belong to its part without a gap
        ahead = None
        for value, before, starts in batches:
            x, here = value.to_numpy(float), np.arange(len(value))
            if not len(x):
                yield pd.Series([], dtype=float)
                continue
            starts = starts.to_numpy(bool)
            x_before = np.concatenate(([np.nan if ahead is None else ahead], x[:-1]))
            told = before.to_numpy(float)
            if ((told != x_before) & ~(np.isnan(told) & np.isnan(x_before)) & ~starts).any():
                raise RuntimeError("rows of a window left their order before the spectral step")
            gap = np.concatenate(([False], np.isnan(x[:-1]))) | (here == 0) & (ahead is not None and np.isnan(ahead))
            base = np.maximum.accumulate(np.where(starts | gap, here, -run))
            run_here = here - base
            full = run_here >= n
            joined = np.concatenate((held, x))
            out = np.full(len(x), np.nan)
            if full.any():
                out[full] = batch_periods(np.lib.stride_tricks.sliding_window_view(joined, n)[:-1][full])
            held, run, ahead = joined[-n:].copy(), int(run_here[-1]) + 1, x[-1]
            yield pd.Series(out).where(lambda s: s.notna(), None)

    return period.asNondeterministic()
