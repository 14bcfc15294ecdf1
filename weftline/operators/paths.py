"""Statistics of returns and of price paths."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import series as S
from weftline.operators.filters import clip
from weftline.plans.joining import join_null_safe
from weftline.plans.ordered import Line
from weftline.plans.quantile import quantiles
from weftline.plans.sizing import written

# Limits and weights of the trend score.
JUMP_DEVIATIONS = 3.0
LEAST_SIGMA = 0.001
SLOPE_LIMIT = 0.01
STRENGTH_SCALE = 10.0
HORIZONS = (5, 10, 21)
CALM_WEIGHT, WILD_WEIGHT = 0.8, 1.5
VOL_ROWS = 5
RIDGE, LEAST_PART = 1e-6, 1e-9
ROUNDS_A_JOB = 5


def log_returns(line: Line, price: str = "close", out: str = "log_ret") -> Line:
    return line.roll(lambda d, f: d.withColumn(out, S.log_return(F.col(price), f)), before=1)


def jump_label(line: Line, ret: str = "log_ret") -> Line:
    """1 where a return lies beyond three population deviations of its series, and the jump size."""
    line = line.whole({"__sd": F.stddev_pop(ret)})
    jump = F.abs(ret) > JUMP_DEVIATIONS * F.col("__sd")
    return line.map(
        lambda d: d.withColumns(
            {
                "jump": F.when(F.col(ret).isNotNull(), F.coalesce(jump, F.lit(False)).cast("int")),
                "jump_size": F.when(F.col(ret).isNotNull(), F.when(jump, F.col(ret)).otherwise(0.0)),
            }
        ).drop("__sd")
    )


def normal_fit(df: DataFrame, key: Sequence[str], ret: str = "log_ret") -> DataFrame:
    """Maximum-likelihood normal of the returns: mean and population deviation, not below 0.001."""
    return df.groupBy(*key).agg(
        F.avg(ret).alias("mu"), F.greatest(F.stddev_pop(ret), F.lit(LEAST_SIGMA)).alias("sigma")
    )


def vol_regime(
    line: Line, ret: str = "log_ret", use_rolling_vol: bool = False, tolerance: float = 1e-3, rounds: int = 100
) -> DataFrame:
    """Calm (0) or wild (1) per row by a two-part normal mixture of the rolling deviation of all series together.

    The parts start at the exact quartiles, and rounds of expectation and maximisation (one combined aggregate each; six
    numbers come back) end when the mean log-likelihood rises by less than ``tolerance``.  Parts are numbered by their mean, so
    1 is always the wilder one.  What is judged is the return itself, or its rolling deviation with ``use_rolling_vol``.
    """
    line = line.roll(lambda d, f: d.withColumn("vol", S.rolling(F.col(ret), VOL_ROWS, "std", f)), before=VOL_ROWS)
    known = written(line.result().filter(F.col("vol").isNotNull() & F.col(ret).isNotNull()), "regime-rows")
    vol = known.select("vol")
    spread = vol.agg(F.var_pop("vol").alias("v")).first()["v"]
    fit = {f"{n}{k}": 0.0 for n in ("share", "mean", "var") for k in (0, 1)}
    if spread is not None:
        ends = quantiles(vol, (), "vol", {"mean0": 0.25, "mean1": 0.75}).first()
        fit = {"share0": 0.5, "share1": 0.5, "mean0": ends["mean0"], "mean1": ends["mean1"], "var0": spread + RIDGE, "var1": spread + RIDGE}
        before = None
        for _ in range(rounds):
            sums, made = _regime_sums(F.col("vol"), _given(fit))
            row = vol.agg(*sums).select("likely", *made).first()
            fit = {c: row[c] for c in fit}
            if before is not None and row["likely"] - before < tolerance:
                break
            before = row["likely"]
    return _judged(known, F.col("vol" if use_rolling_vol else ret), _given(fit))


def _given(fit: dict[str, float]) -> Callable[[str], Column]:
    return lambda name: F.lit(float(fit[name]))


def _judged(rows: DataFrame, x: Column, of: Callable[[str], Column]) -> DataFrame:
    upper = _upper_part(x, of)
    p = F.when(of("mean1") >= of("mean0"), upper).otherwise(1 - upper)
    wild = p > 0.5
    return rows.withColumns(
        {
            "wild_probability": p,
            "regime": wild.cast("int"),
            "vol_weight": F.when(wild, WILD_WEIGHT).otherwise(CALM_WEIGHT),
        }
    )


def vol_regime_per_key(line: Line, ret: str = "log_ret", rounds: int = 20, use_rolling_vol: bool = False) -> DataFrame:
    """``vol_regime`` with a mixture of its own for each key, all keys fitted together.

    A round of expectation and maximisation is one join with a row per key and one aggregate of sums, combined before
    the shuffle, so neither a long series nor many of them meet in one task.  The parts start one deviation below and
    above the mean of the rolling deviation; ``RIDGE`` keeps a variance above zero, so a constant series has two equal
    parts and is calm.
    """
    keys = list(line.keys)
    line = line.roll(lambda d, f: d.withColumn("vol", S.rolling(F.col(ret), VOL_ROWS, "std", f)), before=VOL_ROWS)
    known = written(line.result().filter(F.col("vol").isNotNull() & F.col(ret).isNotNull()), "regime-rows")
    vol = known.select(*keys, "vol")
    start = vol.groupBy(*keys).agg(F.avg("vol").alias("m"), F.stddev_pop("vol").alias("s"))
    fit = start.select(
        *keys,
        *[F.lit(0.5).alias(f"share{k}") for k in (0, 1)],
        (F.col("m") - F.col("s")).alias("mean0"),
        (F.col("m") + F.col("s")).alias("mean1"),
        *[(F.col("s") * F.col("s") + RIDGE).alias(f"var{k}") for k in (0, 1)],
    )
    for i in range(rounds):
        fit = _regime_round(vol, fit, keys)
        if (i + 1) % ROUNDS_A_JOB == 0:
            fit = written(fit, "regime-fit")
    scored = join_null_safe(known, fit, keys, "inner")
    judged = _judged(scored, F.col("vol" if use_rolling_vol else ret), F.col)
    return judged.drop(*[f"{n}{k}" for n in ("share", "mean", "var") for k in (0, 1)])


def _log_density(x: Column, k: int, of: Callable[[str], Column]) -> Column:
    """Up to a constant, with the share of the part."""
    away = x - of(f"mean{k}")
    return F.log(of(f"share{k}")) - F.log(of(f"var{k}")) / 2 - away * away / (of(f"var{k}") * 2)


def _upper_part(x: Column, of: Callable[[str], Column]) -> Column:
    """Probability of part 1 at ``x``."""
    return F.lit(1.0) / (F.exp(_log_density(x, 0, of) - _log_density(x, 1, of)) + 1)


def _regime_sums(x: Column, of: Callable[[str], Column]) -> tuple[list[Column], list[Column]]:
    """Aggregates of a round, and the new parameters from them: shares, means, variances; an empty part stays as it is."""
    upper = _upper_part(x, of)
    lower, higher = _log_density(x, 0, of), _log_density(x, 1, of)
    likely = F.greatest(lower, higher) + F.log1p(F.exp(-F.abs(lower - higher)))
    sums, made = [F.count(F.lit(1)).alias("n"), F.avg(likely).alias("likely")], []
    for k, p in ((0, 1 - upper), (1, upper)):
        sums += [F.sum(p).alias(f"p{k}"), F.sum(p * x).alias(f"x{k}"), F.sum(p * x * x).alias(f"xx{k}")]
        sums += [F.any_value(of(f"{c}{k}")).alias(f"{c}{k}") for c in ("mean", "var")]
        size, mean = F.col(f"p{k}"), F.col(f"x{k}") / F.col(f"p{k}")
        some = size > LEAST_PART
        made += [
            F.greatest(size / F.col("n"), F.lit(LEAST_PART)).alias(f"share{k}"),
            F.when(some, mean).otherwise(F.col(f"mean{k}")).alias(f"mean{k}"),
            F.when(some, F.greatest(F.col(f"xx{k}") / size - mean * mean, F.lit(0.0)) + RIDGE).otherwise(F.col(f"var{k}")).alias(f"var{k}"),
        ]
    return sums, made


def _regime_round(vol: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    sums, made = _regime_sums(F.col("vol"), F.col)
    return join_null_safe(vol, fit, keys, "inner").groupBy(*keys).agg(*sums).select(*keys, *made)


def path_slope(paths: DataFrame, path: str = "path_id", step: str = "step", price: str = "price", key: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope of each path."""
    return paths.groupBy(*key, path).agg(F.regr_slope(price, step).alias("slope"))


def path_forecast(slopes: DataFrame, key: Sequence[str] = (), weight: float | str = 1.0) -> DataFrame:
    """Shares of rising and falling paths, bounded trend strength and the 5–95 % range of slopes.

    ``weight`` is a number or the name of a column that is constant per key.
    """
    w: Column = F.col(weight) if isinstance(weight, str) else F.lit(weight)
    slopes = slopes.filter(F.col("slope").isNotNull())
    limit = F.lit(SLOPE_LIMIT) / w
    shares = slopes.groupBy(*key).agg(
        F.avg((F.col("slope") > limit).cast("double")).alias("up_prob"),
        F.avg((F.col("slope") < -limit).cast("double")).alias("down_prob"),
        F.tanh(F.avg("slope") * STRENGTH_SCALE * F.max(w)).alias("trend_strength"),
    )
    spread = quantiles(slopes, key, "slope", {"slope_p05": 0.05, "slope_p95": 0.95})
    if key:
        return shares.join(spread, list(key))
    ends = spread.select(F.struct("*").alias("s")).scalar()
    return shares.withColumns({"slope_p05": ends["slope_p05"], "slope_p95": ends["slope_p95"]})


def recent_vol(df: DataFrame, key: Sequence[str], order: Sequence[str], ret: str = "log_ret", lookback: int = 21) -> DataFrame:
    """Deviation of the last ``lookback`` returns per key."""
    return S.tail_per_key(df, list(key), list(order), lookback).groupBy(*key).agg(F.stddev_samp(ret).alias("vol"))


def composite_signal(vol: DataFrame, strengths: DataFrame, key: Sequence[str]) -> DataFrame:
    """Strengths per horizon, weighted by ``exp(-h / (100 vol))``, as one score within ±1.

    ``strengths`` has one column ``s_<h>`` per horizon.  A key without strengths keeps its row, its signal is null.
    """
    both = vol.join(strengths, list(key), "left")
    raw = {h: F.exp(F.try_divide(F.lit(-float(h)), F.col("vol") * 100)) for h in HORIZONS}
    total = sum(raw.values(), F.lit(0.0))
    score = sum((F.try_divide(raw[h], total) * F.col(f"s_{h}") for h in HORIZONS), F.lit(0.0))
    return both.select(
        *key,
        "vol",
        *[F.try_divide(raw[h], total).alias(f"w_{h}") for h in HORIZONS],
        clip(score, -1.0, 1.0).alias("signal"),
    )
