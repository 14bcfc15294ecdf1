"""Technical indicators on bars (open, high, low, close, volume).

An indicator is a short list of stages with its reach in rows, so that any
number of them shares one shuffle and one pass over the rows.  Where two
formulas are in use for one name, ``variant`` picks one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.spectrum import dominant_period as period_of
from weftline.operators import series as S
from weftline.plans.ordered import Frame, Line

EPS = 1e-9

# Usual look-back lengths and smoothing spans.
RSI_ROWS = 14
ATR_ROWS = 14
BAND_ROWS = 20
STOCHASTIC_ROWS = 14
STOCHASTIC_MEAN = 3
MFI_ROWS = 14
CCI_ROWS = 20
CCI_SCALE = 0.015
ROC_ROWS = 10
MACD_SPANS = (12, 26, 9)
GARCH_ALPHA = 0.1
GARCH_BETA = 0.85
SPECTRUM_ROWS = 60


Columns = Callable[[Frame], dict[str, Column]]
Terms = dict[str, tuple[Column, float]]


@dataclass(frozen=True)
class Recursion:
    """Recurrences of one kind: ``recursive``/``adjusted`` means (x, alpha) or ``plain`` (b, decay)."""

    kind: str
    terms: Terms

    def decays(self) -> list[float]:
        return [a if self.kind == "plain" else 1.0 - a for _, a in self.terms.values()]


RUN = {"recursive": S.ewm_recursive, "adjusted": S.ewm_adjusted, "plain": S.recurrence}


@dataclass(frozen=True)
class Indicator:
    """Stages to run one after the other, the rows they look back on, and the columns that stay.

    A stage is a set of columns or a recurrence.  Scratch columns start with
    two underscores; equal names mean equal values and are computed once.
    """

    stages: tuple[Columns | Recursion, ...]
    reach: int
    outputs: tuple[str, ...]


def add(line: Line, *indicators: Indicator) -> Line:
    """Put indicators on a line, all in the same pass.

    The stages of all indicators are run level by level: one projection, one
    window operator and one recurrence per level, whatever their number.
    """
    levels = list(zip_longest(*[i.stages for i in indicators]))
    decays = [d for level in levels for s in level if isinstance(s, Recursion) for d in s.decays()]

    def build(d: DataFrame, f: Frame) -> DataFrame:
        before = set(d.columns)
        if decays:
            d, f = S.chunked(d, f, decays)
        for level in levels:
            columns: dict[str, Column] = {}
            recursions: dict[str, Terms] = {}
            for stage in level:
                if isinstance(stage, Recursion):
                    recursions.setdefault(stage.kind, {}).update(stage.terms)
                elif stage is not None:
                    columns.update(stage(f))
            if columns:
                d = d.withColumns(columns)
            for kind, terms in recursions.items():
                d = RUN[kind](d, f, terms)
        kept = {o for i in indicators for o in i.outputs}
        return d.drop(*[c for c in d.columns if c.startswith("__") and c not in before and c not in kept])

    return line.roll(build, before=max(i.reach for i in indicators))


def _strength_index(gain: Column, loss: Column) -> Column:
    """100 - 100 / (1 + gain / loss), with the limits of a zero loss spelled out."""
    return F.when(loss != 0, 100 - 100 / (1 + gain / loss)).when(gain > 0, F.lit(100.0))


def _move(f: Frame) -> dict[str, Column]:
    return {"__move": S.diff(F.col("close"), f)}


def _typical(f: Frame) -> dict[str, Column]:
    return {"__tp": (F.col("high") + F.col("low") + F.col("close")) / 3.0}


def _extremes(n: int) -> Columns:
    """Lowest low and highest high of the last ``n`` rows."""

    def columns(f: Frame) -> dict[str, Column]:
        return {
            f"__low_{n}": S.rolling(F.col("low"), n, "min", f),
            f"__high_{n}": S.rolling(F.col("high"), n, "max", f),
        }

    return columns


def rsi(variant: str = "wilder", n: int = RSI_ROWS, out: str = "rsi") -> Indicator:
    """Relative strength index: ``wilder`` smoothing (alpha 1/n) or ``sma``."""
    g, l = f"__{out}_gain", f"__{out}_loss"
    u, v = f"__{out}_up", f"__{out}_down"
    move = F.col("__move")

    def index(f: Frame) -> dict[str, Column]:
        return {out: _strength_index(F.col(g), F.col(l))}

    if variant == "wilder":
        up = F.when(move.isNotNull(), F.greatest(move, F.lit(0.0)))
        down = F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))
        smooth = Recursion("recursive", {g: (up, 1.0 / n), l: (down, 1.0 / n)})
        return Indicator((_move, smooth, index), 1 + S.ewm_reach(1.0 / n), (out,))

    def sides(f: Frame) -> dict[str, Column]:
        return {u: F.when(move > 0, move).otherwise(0.0), v: F.when(move < 0, -move).otherwise(0.0)}

    def means(f: Frame) -> dict[str, Column]:
        return {g: S.rolling(F.col(u), n, "mean", f), l: S.rolling(F.col(v), n, "mean", f)}

    if variant == "sma":
        return Indicator((_move, sides, means, index), n, (out,))
    raise ValueError("variant is 'wilder' or 'sma'")


def macd(variant: str = "recursive", prefix: str = "macd") -> Indicator:
    """Fast minus slow exponential mean, its signal line and (recursive form) the difference."""
    if variant not in ("recursive", "adjusted"):
        raise ValueError("variant is 'recursive' or 'adjusted'")
    fast, slow, sign = (S.alpha_of(span=s) for s in MACD_SPANS)
    line, signal, hist = f"{prefix}_line", f"{prefix}_signal", f"{prefix}_hist"
    a, b = f"__{prefix}_fast", f"__{prefix}_slow"
    stages = (
        Recursion(variant, {a: (F.col("close"), fast), b: (F.col("close"), slow)}),
        lambda f: {line: F.col(a) - F.col(b)},
        Recursion(variant, {signal: (F.col(line), sign)}),
    )
    outs = (line, signal)
    if variant == "recursive":
        stages, outs = (*stages, lambda f: {hist: F.col(line) - F.col(signal)}), (*outs, hist)
    return Indicator(stages, S.ewm_reach(fast, slow) + S.ewm_reach(sign), outs)


def macd_gaps(line: Line, prefix: str = "macd") -> Line:
    """Recursive MACD of closes with gaps: both means are carried over a gap, and so are their difference and its mean."""
    fast, slow, sign = (S.alpha_of(span=s) for s in MACD_SPANS)
    out, signal, hist = f"{prefix}_line", f"{prefix}_signal", f"{prefix}_hist"
    line = S.ewm_gaps(line, {"__fast": (F.col("close"), fast), "__slow": (F.col("close"), slow)})
    line = line.map(lambda d: d.withColumn(out, F.col("__fast") - F.col("__slow")).drop("__fast", "__slow"))
    line = S.ewm_gaps(line, {signal: (F.col(out), sign)})
    return line.map(lambda d: d.withColumn(hist, F.col(out) - F.col(signal)))


def rsi_gaps(line: Line, n: int = RSI_ROWS, out: str = "rsi") -> Line:
    """Relative strength index, Wilder smoothing, of closes with gaps; a move is known where both its closes are."""
    move = F.col("__move")
    line = line.roll(lambda d, f: d.withColumns(_move(f)), before=1)
    sides = {"__gain": (F.greatest(move, F.lit(0.0)), 1.0 / n), "__loss": (F.greatest(-move, F.lit(0.0)), 1.0 / n)}
    sides = {o: (F.when(move.isNotNull(), c), a) for o, (c, a) in sides.items()}
    line = S.ewm_gaps(line, sides)
    return line.map(
        lambda d: d.withColumn(out, _strength_index(F.col("__gain"), F.col("__loss"))).drop("__move", "__gain", "__loss")
    )


def atr(variant: str = "true_range", n: int = ATR_ROWS, out: str = "atr") -> Indicator:
    """Mean range: ``true_range`` takes the gap to the close before into account, ``simple`` does not."""
    if variant not in ("true_range", "simple"):
        raise ValueError("variant is 'true_range' or 'simple'")
    tr = f"__{out}_range"

    def spans(f: Frame) -> dict[str, Column]:
        span = F.col("high") - F.col("low")
        if variant == "true_range":
            before = S.shift(F.col("close"), 1, f)
            span = F.greatest(span, F.abs(F.col("high") - before), F.abs(F.col("low") - before))
        return {tr: span}

    return Indicator((spans, lambda f: {out: S.rolling(F.col(tr), n, "mean", f)}), n, (out,))


def bollinger(n: int = BAND_ROWS, width: float = 2.0, prefix: str = "bb") -> Indicator:
    """Rolling mean, and the lines ``width`` deviations above and below it."""
    mid, upper, lower, dev = f"{prefix}_mid", f"{prefix}_upper", f"{prefix}_lower", f"__{prefix}_dev"

    def spread(f: Frame) -> dict[str, Column]:
        return {mid: S.rolling(F.col("close"), n, "mean", f), dev: S.rolling(F.col("close"), n, "std", f)}

    def bands(f: Frame) -> dict[str, Column]:
        band = F.lit(width) * F.col(dev)
        return {upper: F.col(mid) + band, lower: F.col(mid) - band}

    return Indicator((spread, bands), n - 1, (mid, upper, lower))


def stochastic(variant: str = "guarded", n: int = STOCHASTIC_ROWS, prefix: str = "stoch") -> Indicator:
    """Place of the close in the n-row range, and its short mean.

    ``guarded`` adds 1e-9 to the range; ``plain`` gives null on a flat range.
    """
    if variant not in ("guarded", "plain"):
        raise ValueError("variant is 'guarded' or 'plain'")
    k, d = f"{prefix}_k", f"{prefix}_d"

    def place(f: Frame) -> dict[str, Column]:
        span = F.col(f"__high_{n}") - F.col(f"__low_{n}")
        rise = F.col("close") - F.col(f"__low_{n}")
        return {k: (rise / (span + EPS) if variant == "guarded" else F.try_divide(rise, span)) * 100}

    def mean(f: Frame) -> dict[str, Column]:
        return {d: S.rolling(F.col(k), STOCHASTIC_MEAN, "mean", f)}

    return Indicator((_extremes(n), place, mean), n + STOCHASTIC_MEAN - 2, (k, d))


def mfi(n: int = MFI_ROWS, out: str = "mfi") -> Indicator:
    """Money flow index: flow counts as positive or negative by the move of the typical price."""
    dt, p, q = f"__{out}_move", f"__{out}_in", f"__{out}_out"

    def move(f: Frame) -> dict[str, Column]:
        return {dt: S.diff(F.col("__tp"), f)}

    def flows(f: Frame) -> dict[str, Column]:
        flow = F.col("__tp") * F.col("volume")
        return {p: F.when(F.col(dt) > 0, flow).otherwise(0.0), q: F.when(F.col(dt) < 0, flow).otherwise(0.0)}

    def index(f: Frame) -> dict[str, Column]:
        gain, loss = S.rolling(F.col(p), n, "sum", f), S.rolling(F.col(q), n, "sum", f)
        return {out: 100 - 100 / (1 + gain / (loss + EPS))}

    return Indicator((_typical, move, flows, index), n, (out,))


def cci(n: int = CCI_ROWS, out: str = "cci") -> Indicator:
    """Commodity channel index; the deviation is the mean of each row's distance to its own mean."""
    dev = f"__{out}_dev"

    def distance(f: Frame) -> dict[str, Column]:
        return {dev: F.col("__tp") - S.rolling(F.col("__tp"), n, "mean", f)}

    def index(f: Frame) -> dict[str, Column]:
        mean = S.rolling(F.abs(F.col(dev)), n, "mean", f)
        return {out: F.try_divide(F.col(dev), F.lit(CCI_SCALE) * mean)}

    return Indicator((_typical, distance, index), 2 * (n - 1), (out,))


def williams_r(n: int = STOCHASTIC_ROWS, out: str = "williams_r") -> Indicator:
    """Distance of the close to the n-row high, in percent of the range, negative."""

    def index(f: Frame) -> dict[str, Column]:
        hi, lo = F.col(f"__high_{n}"), F.col(f"__low_{n}")
        return {out: (hi - F.col("close")) / (hi - lo + EPS) * -100}

    return Indicator((_extremes(n), index), n - 1, (out,))


def roc(n: int = ROC_ROWS, out: str = "roc") -> Indicator:
    return Indicator((lambda f: {out: S.pct_change(F.col("close"), f, n) * 100},), n, (out,))


def returns(out: str = "ret", scale: float = 1.0) -> Indicator:
    """Relative change to the row before, 0 in the first row."""

    def change(f: Frame) -> dict[str, Column]:
        return {out: F.coalesce(S.pct_change(F.col("close"), f), F.lit(0.0)) * scale}

    return Indicator((change,), 1, (out,))


def return1(out: str = "return1") -> Indicator:
    return returns(out, 100.0)


def signed_volume(out: str = "signed_volume") -> Indicator:
    """Volume with the sign of the price move; the summand of on-balance volume."""

    def flow(f: Frame) -> dict[str, Column]:
        move = F.coalesce(S.diff(F.col("close"), f), F.lit(0.0))
        return {out: F.signum(move) * F.col("volume")}

    return Indicator((flow,), 1, (out,))


def obv(line: Line, out: str = "obv") -> Line:
    """On-balance volume: running sum of signed volume."""
    line = S.cumsum(add(line, signed_volume("__flow")), {out: F.col("__flow")})
    return line.map(lambda d: d.drop("__flow"))


def variance_path(ret: str, v0: str, out: str = "garch_vol") -> Indicator:
    """GARCH(1,1) volatility from a return column and its whole-series variance."""
    level = F.col(v0) * max(0.0, 1 - GARCH_ALPHA - GARCH_BETA)
    v = f"__{out}_v"

    def start(f: Frame) -> dict[str, Column]:
        return {f"__{out}_first": F.lag(F.lit(1), 1).over(f.spec()).isNull()}

    b = F.when(F.col(f"__{out}_first"), F.col(v0)).otherwise(level + GARCH_ALPHA * F.col(ret) * F.col(ret))
    stages = (
        start,
        Recursion("plain", {v: (b, GARCH_BETA)}),
        lambda f: {out: F.when(F.col(v0).isNotNull(), F.sqrt(v))},
    )
    return Indicator(stages, S.reach(GARCH_BETA), (out,))


def garch_vol(line: Line, out: str = "garch_vol") -> Line:
    """GARCH(1,1) volatility of returns.

    The start value and the level come from the variance of the whole series,
    so early rows know later ones.
    """
    line = add(line, returns("__r")).whole({"__v0": F.var_samp("__r")})
    return add(line, variance_path("__r", "__v0", out)).map(lambda d: d.drop("__r", "__v0"))


def raw_period(n: int = SPECTRUM_ROWS, out: str = "dominant_period") -> Indicator:
    """Spectral period of the ``n`` closes before the row."""
    udf, before, first = period_of(n), f"__{out}_before", f"__{out}_first"

    def neighbours(f: Frame) -> dict[str, Column]:
        lag = F.lag(F.lit(1), 1).over(f.spec())
        return {"__period_close": F.col("close").cast("double"), before: F.lag(F.col("close").cast("double"), 1).over(f.spec()), first: lag.isNull()}

    return Indicator((neighbours, lambda f: {out: udf("__period_close", before, first)}), n, (out,))


def smooth(line: Line, column: str) -> Line:
    """Centred mean of three."""
    return line.roll(
        lambda d, f: d.withColumn(column, S.rolling_centered(F.col(column), 3, "mean", f)), before=1, after=1
    )


def dominant_period(line: Line, n: int = SPECTRUM_ROWS, out: str = "dominant_period") -> Line:
    """Spectral period with the gaps between known values filled, smoothed."""
    return smooth(S.interpolate(add(line, raw_period(n, out)), [out], mode="inside"), out)


FEATURES = (
    "rsi", "macd_line", "macd_signal", "macd_hist", "atr", "bb_mid", "bb_upper", "bb_lower", "obv",
    "stoch_k", "stoch_d", "mfi", "cci", "williams_r", "roc", "garch_vol", "dominant_period", "return1",
    "close", "volume",
)

GROUPED_FEATURES = (
    "macd_line", "macd_signal", "rsi", "atr", "bb_upper", "bb_lower", "obv", "stoch_k", "stoch_d",
)


def feature_frame(line: Line, target: str = "up_next") -> DataFrame:
    """All indicators, complete rows only, and whether the next complete row closes higher."""
    line = add(line, returns("__r")).whole({"__v0": F.var_samp("__r")})
    line = add(
        line,
        rsi("wilder"),
        macd("recursive"),
        variance_path("__r", "__v0"),
        atr("true_range"),
        bollinger(),
        stochastic("guarded"),
        mfi(),
        cci(),
        williams_r(),
        roc(),
        signed_volume("__flow"),
    )
    # the Arrow step loses the partitioning: after all else that needs the rows of a key together
    line = add(line, raw_period())
    # running volume and the gaps of the period need the whole key: one scan for both
    period = ["dominant_period"]
    lasts, nexts = S.gap_ends(period, "__at")
    line = line.with_position("__at").scan(sums={"obv": F.col("__flow")}, lasts=lasts, nexts=nexts)
    line = line.map(
        lambda d: S.fill_gaps(d, period, "__at", "inside")
        .withColumns(
            {"obv": F.when(F.col("__flow").isNotNull(), F.col("obv")), "return1": F.col("__r") * 100}
        )
        .drop("__at", "__r", "__v0", "__flow")
    )
    line = smooth(line, "dominant_period")
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in FEATURES])
    line = line.scan(nexts={"__next": F.when(whole, F.col("close"))}, strict=True)
    up = F.coalesce(F.col("__next") > F.col("close"), F.lit(False)).cast("int")
    return line.result().na.drop(subset=list(FEATURES)).withColumn(target, up).drop("__next")


def feature_frame_grouped(line: Line, target: str = "target") -> DataFrame:
    """The second indicator set, per ticker, with the target five rows ahead; complete rows only."""
    line = add(
        line,
        macd("adjusted"),
        rsi("sma"),
        atr("simple"),
        bollinger(),
        stochastic("plain"),
        signed_volume("__flow"),
    )
    line = S.cumsum(line, {"obv": F.col("__flow")}).map(lambda d: d.drop("__flow"))
    line = S.target_next(line, "close", 5, target)
    return line.result().na.drop()
