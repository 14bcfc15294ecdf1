"""Classifiers and regimes: properties only, their numbers are not fixed."""

import pytest
from pyspark.sql import functions as F

from weftline import Line
from weftline.operators import decide, models, paths
from weftline.operators import indicators as I
from weftline.operators import series as S
from weftline.sources.bars import bars

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def features(spark):
    line = Line.of(bars(spark.read.parquet(f"{SF}/events.parquet")), "ticker", "bar_ts")
    d = S.split_by_hash(I.feature_frame_grouped(line), F.xxhash64("ticker", "bar_ts"))
    return d.cache()


def test_forest(spark, features):
    fitted = models.forest(features.filter("part = 'train'"), I.GROUPED_FEATURES, "target", trees=10)
    scored = fitted.score(features)
    assert scored.count() == features.count()
    lo, hi = scored.agg(F.min("probability"), F.max("probability")).first()
    assert 0 <= lo <= hi <= 1
    weights = fitted.importances(spark)
    assert weights.count() == len(I.GROUPED_FEATURES)
    assert weights.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    acc = decide.accuracy(scored.filter("part = 'test'"), "target", "prediction").first()[0]
    assert 0 <= acc <= 1
    report = decide.stocks_report(scored)
    assert report.count() == 5
    assert report.filter("(recommendation = 'Sell') <> (reentry_price IS NOT NULL)").count() == 0


def test_boost(spark, features):
    fitted = models.boost(features.filter("part = 'train'"), I.GROUPED_FEATURES, "target", rounds=3)
    assert fitted.score(features).filter("probability NOT BETWEEN 0 AND 1").count() == 0


def test_regime(spark):
    line = Line.of(bars(spark.read.parquet(f"{SF}/events.parquet")), "ticker", "bar_ts")
    line = paths.log_returns(line)
    for rolling in (False, True):
        got = paths.vol_regime(line, use_rolling_vol=rolling)
        assert {r[0] for r in got.select("regime").distinct().collect()} <= {0, 1}
        odd = got.filter((F.col("regime") == 1) != (F.col("vol_weight") == 1.5)).count()
        assert odd == 0
    wild = got.groupBy("regime").agg(F.avg("vol").alias("v")).orderBy("regime").collect()
    if len(wild) == 2:
        assert wild[0]["v"] < wild[1]["v"]
