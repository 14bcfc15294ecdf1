"""The split plan must give the rows of the plain plan and of pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline import Line
from weftline.operators import indicators as I
from weftline.operators import series as S
from weftline.sources.bars import bars


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(7)
    rows = []
    for key, n in (("hot", 1500), ("b", 120), ("c", 3)):
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        for i in range(n):
            hi, lo = close[i] + rng.random(), close[i] - rng.random()
            x = None if rng.random() < 0.3 else float(rng.integers(0, 9))
            rows.append((key, i * 3, float(close[i]), float(hi), float(lo), float(rng.integers(1, 99)), x))
    rng.shuffle(rows)
    rows = [(r[0], int(r[1]), *[None if v is None else float(v) for v in r[2:]]) for r in rows]
    df = spark.createDataFrame(rows, "ticker string, t long, close double, high double, low double, volume double, x double")
    return df.repartition(5).cache()


def lines(df, limit=200):
    plain, cut = Line.of(df, "ticker", "t"), Line.of(df, "ticker", "t", limit)
    assert not plain.split and cut.split
    return plain, cut


def frame(df):
    out = df.toPandas().sort_values(["ticker", "t"]).reset_index(drop=True)
    return out[sorted(out.columns)]


def same(a, b, rtol=1e-9):
    pd.testing.assert_frame_equal(frame(a), frame(b), rtol=rtol, atol=1e-9, check_dtype=False)


def test_positions(walk):
    plain, cut = lines(walk)
    got = frame(cut.with_position("p").result())
    assert (got["p"] == got["t"] // 3).all()
    same(plain.with_position("p").result(), got_df(cut.with_position("p")))


def got_df(line):
    return line.result()


def test_rolling_matches_pandas(walk):
    def build(d, f):
        return d.withColumns(
            {
                "m": S.rolling(F.col("x"), 4, "mean", f),
                "s": S.rolling(F.col("close"), 5, "std", f),
                "c": S.rolling_centered(F.col("close"), 3, "mean", f),
                "d": S.diff(F.col("close"), f),
                "ahead": S.shift(F.col("close"), -2, f),
            }
        )

    plain, cut = lines(walk)
    a, b = plain.roll(build, 5, 2).result(), cut.roll(build, 5, 2).result()
    same(a, b)
    p = frame(walk)
    want = p.groupby("ticker", group_keys=False)
    got = frame(a)
    np.testing.assert_allclose(got["m"], want["x"].transform(lambda s: s.rolling(4).mean()))
    np.testing.assert_allclose(got["s"], want["close"].transform(lambda s: s.rolling(5).std()))
    np.testing.assert_allclose(
        got["c"], want["close"].transform(lambda s: s.rolling(3, center=True, min_periods=1).mean())
    )
    np.testing.assert_allclose(got["ahead"], want["close"].transform(lambda s: s.shift(-2)))


def test_ewm_matches_pandas(walk):
    plain, cut = lines(walk)
    want = frame(walk).groupby("ticker", group_keys=False)["close"]
    for adjust in (True, False):
        a = S.ewm(plain, {"y": (F.col("close"), 2 / 27)}, adjust).result()
        same(a, S.ewm(cut, {"y": (F.col("close"), 2 / 27)}, adjust).result())
        np.testing.assert_allclose(frame(a)["y"], want.transform(lambda s: s.ewm(span=26, adjust=adjust).mean()))


@pytest.mark.parametrize("chunk", [130, 300, 1000])
def test_chunk_size_does_not_matter(walk, chunk):
    plain = Line.of(walk, "ticker", "t")
    a = S.linear_recurrence(plain, {"y": (F.col("close"), 0.7)}).result()
    b = S.linear_recurrence(plain, {"y": (F.col("close"), 0.7)}, chunk).result()
    same(a, b, 1e-12)


def test_recurrence_matches_loop(walk):
    got = frame(S.linear_recurrence(Line.of(walk, "ticker", "t"), {"y": (F.col("close"), 0.85)}, 300).result())
    for _, g in got.groupby("ticker"):
        y, want = 0.0, []
        for v in g["close"]:
            y = 0.85 * y + v
            want.append(y)
        np.testing.assert_allclose(g["y"], want, rtol=1e-12)


def test_scans(walk):
    plain, cut = lines(walk)
    p = frame(walk)
    by = p.groupby("ticker", group_keys=False)
    for line in (plain, cut):
        np.testing.assert_allclose(
            frame(S.cumsum(line, {"s": F.col("x")}).result())["s"], by["x"].transform(lambda s: s.cumsum())
        )
        np.testing.assert_allclose(frame(S.ffill(line, ["x"]).result())["x"], by["x"].transform(lambda s: s.ffill()))
        np.testing.assert_allclose(frame(S.bfill(line, ["x"]).result())["x"], by["x"].transform(lambda s: s.bfill()))
        np.testing.assert_allclose(
            frame(S.interpolate(line, ["x"]).result())["x"], by["x"].transform(lambda s: s.interpolate())
        )
        np.testing.assert_allclose(
            frame(S.interpolate(line, ["x"], "inside").result())["x"],
            by["x"].transform(lambda s: s.interpolate(limit_area="inside")),
        )


def test_split_and_target(walk):
    plain, cut = lines(walk)
    same(S.split_by_time(plain).result(), S.split_by_time(cut).result())
    same(S.target_next(plain, k=5).result(), S.target_next(cut, k=5).result())
    got = frame(S.split_by_time(plain).result())
    assert (got[got.ticker == "b"]["part"] == ["train"] * 96 + ["test"] * 24).all()


def test_feature_frames_do_not_depend_on_the_plan(walk):
    plain, cut = lines(walk.drop("x"), 700)
    a = I.feature_frame(plain)
    same(a, I.feature_frame(cut), 1e-7)
    same(I.feature_frame_grouped(plain), I.feature_frame_grouped(cut), 1e-7)
    alone = I.feature_frame(Line.of(walk.drop("x").filter("ticker = 'b'"), "ticker", "t"))
    same(a.filter("ticker = 'b'"), alone)


def test_first_valid_rows(spark):
    b = bars(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    line = Line.of(b, "ticker", "bar_ts").with_position("at")
    inds = [I.rsi("wilder"), I.macd(), I.atr(), I.bollinger(), I.mfi(), I.cci(), I.williams_r(), I.roc(), I.stochastic()]
    out = I.obv(I.garch_vol(I.dominant_period(I.add(line, *inds)))).result()
    cols = ["rsi", "macd_hist", "atr", "bb_mid", "mfi", "cci", "williams_r", "roc", "stoch_k", "stoch_d", "obv",
            "garch_vol", "dominant_period"]
    got = out.filter("ticker = 'click'").agg(*[F.min(F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in cols])
    assert list(got.first()) == [1, 0, 13, 19, 13, 38, 13, 10, 13, 15, 0, 0, 59]


def test_recursive_mean_refuses_gaps(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 10.0, None, 12.0])], "k string, i int, x double")
    line = S.ewm(Line.of(df, "k", "i"), {"y": (F.col("x"), 0.5)}, adjust=False)
    with pytest.raises(Exception, match="gap"):
        line.result().collect()
    known = S.ewm(Line.of(df.filter("i != 2"), "k", "i"), {"y": (F.col("x"), 0.5)}, adjust=False)
    assert [r["y"] for r in known.result().orderBy("i").collect()] == [None, 10.0, 11.0]


def test_means_over_gaps_match_pandas(walk):
    plain, cut = lines(walk)
    got = S.ewm_gaps(plain, {"y": (F.col("x"), 0.5), "z": (F.col("x"), 2 / 27)}).result()
    same(got, S.ewm_gaps(cut, {"y": (F.col("x"), 0.5), "z": (F.col("x"), 2 / 27)}).result())
    a = frame(got)
    for out, alpha in (("y", 0.5), ("z", 2 / 27)):
        want = a.groupby("ticker")["x"].transform(lambda s, q=alpha: s.ewm(alpha=q, adjust=False).mean())
        np.testing.assert_allclose(a[out], want)


def test_mean_over_long_gaps(spark):
    x = [None, None, 10.0, 11.0, None, None, 12.0, 13.0, None, 14.0] + [None] * 400 + [15.0, None] * 300 + [None] * 900 + [2.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "ticker string, t long, x double")
    want = pd.Series(x, dtype=float)
    alphas = {"half": 0.5, "slow": 2 / 27, "full": 0.9999}
    for limit in (10**6, 700):
        got = frame(S.ewm_gaps(Line.of(df, "ticker", "t", limit), {o: (F.col("x"), a) for o, a in alphas.items()}).result())
        for o, a in alphas.items():
            np.testing.assert_allclose(got[o], want.ewm(alpha=a, adjust=False).mean())
    none = S.ewm_gaps(Line.of(df.filter("t < 2"), "ticker", "t"), {"y": (F.col("x"), 0.5)}).result()
    assert [r.y for r in none.collect()] == [None, None]
    assert S.ewm_gaps(Line.of(df.limit(0), "ticker", "t"), {"y": (F.col("x"), 0.5)}).result().count() == 0


def test_macd_and_rsi_over_gaps(walk):
    holes = walk.withColumn("close", F.when(F.col("x").isNotNull(), F.col("close")))
    for line in lines(holes):
        a = frame(I.rsi_gaps(I.macd_gaps(line)).result())
        for _, g in a.groupby("ticker"):
            c = g["close"]
            m = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
            np.testing.assert_allclose(g["macd_line"], m, atol=1e-9)
            np.testing.assert_allclose(g["macd_hist"], m - m.ewm(span=9, adjust=False).mean(), atol=1e-9)
            d = c.diff()
            up, down = (s.ewm(alpha=1 / 14, adjust=False).mean() for s in (d.clip(lower=0), -d.clip(upper=0)))
            rsi = (100 - 100 / (1 + up / down)).where(~((down == 0) & (up == 0)))
            np.testing.assert_allclose(g["rsi"], rsi, atol=1e-7)


def test_bars_are_hashed(spark):
    plan = bars(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_split_random_is_a_partition(spark):
    df = spark.range(3000).repartition(7)
    train, test = S.split_random(df, ["id"], share=0.25)
    assert train.count() + test.count() == 3000 and train.join(test, "id").count() == 0
    assert 600 < test.count() < 900


def test_spectral_step_keeps_rows_between_batches(spark):
    """Batches of 7 rows, gaps, several keys and a filter above: each row sees exactly the values before it."""
    import numpy as np

    from weftline.functions.spectrum import batch_periods

    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("a", 150), ("b", 9), ("c", 80)):
        for i in range(n):
            close = float(np.sin(i / 1.7) + 0.1 * rng.normal()) if (key, i) != ("a", 70) else None
            rows.append((key, i, close))
    by_key = {k: [r[2] for r in rows if r[0] == k] for k in "abc"}
    want = {}
    for key, values in by_key.items():
        for i in range(len(values)):
            past = values[i - 16 : i] if i >= 16 else []
            got = batch_periods(np.array([past], float))[0] if past and None not in past else np.nan
            want[key, i] = None if np.isnan(got) else got
    df = spark.createDataFrame(rows, "k string, i int, close double").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for limit in (None, 30):
            line = I.add(Line.of(df, "k", "i", limit), I.raw_period(16))
            out = line.result().filter("i % 3 = 0").collect()
            assert {(r.k, r.i): r.dominant_period for r in out} == {k: v for k, v in want.items() if k[1] % 3 == 0}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
