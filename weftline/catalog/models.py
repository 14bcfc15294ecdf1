"""Return statistics, paths, classifiers and decisions."""

from pyspark.sql import functions as F

from weftline.catalog import tree_sql
from weftline.catalog.indicators import FEATURE_SQL, GROUPED_SQL
from weftline.catalog.registry import BARS, NUMBERED, OVER, bar_line, bars, last_rows, query, r, rounded, rs, table
from weftline.catalog.series import LOG_RET
from weftline.operators import decide, paths, trees
from weftline.operators import indicators as I
from weftline.operators import series as S
from weftline.plans.ordered import Line
from weftline.plans.sizing import written

VALUES = ("open", "high", "low", "close", "volume")
RETURNS = f"{BARS}, lr AS (SELECT ticker, bar_ts, {LOG_RET} AS log_ret FROM bars)"


def return_line(spark, sf):
    return paths.log_returns(bar_line(spark, sf))


@query(
    "jump_label",
    f"""WITH {RETURNS}, s AS (SELECT *, stddev_pop(log_ret) OVER (PARTITION BY ticker) AS sd FROM lr)
    SELECT ticker, bar_ts, CASE WHEN log_ret IS NOT NULL THEN CAST(abs(log_ret) > 3 * sd AS INTEGER) END AS jump,
           {r("CASE WHEN log_ret IS NULL THEN NULL WHEN abs(log_ret) > 3 * sd THEN log_ret ELSE 0.0 END", "jump_size")} FROM s""",
)
def _(spark, sf):
    return rounded(paths.jump_label(return_line(spark, sf)).result().select("ticker", "bar_ts", "jump", "jump_size"))


@query(
    "normal_fit",
    f"""WITH {RETURNS} SELECT ticker, {r("avg(log_ret)", "mu")}, {r("greatest(stddev_pop(log_ret), 0.001)", "sigma")}
    FROM lr GROUP BY 1""",
)
def _(spark, sf):
    return rounded(paths.normal_fit(return_line(spark, sf).result(), ["ticker"]))


def regime_part(x, k):
    return f"ln(share{k}) - ln(var{k}) / 2 - ({x} - mean{k}) ** 2 / (2 * var{k})"


def upper_part(x):
    return f"1 / (1 + exp({regime_part(x, 0)} - ({regime_part(x, 1)})))"


REGIME_ROUNDS = 20


@query(
    "vol_regime_per_series",
    f"""WITH RECURSIVE {RETURNS}, v AS (
      SELECT ticker, bar_ts, log_ret, stddev_samp(log_ret) {last_rows(paths.VOL_ROWS)} AS vol FROM lr
      QUALIFY count(log_ret) {last_rows(paths.VOL_ROWS)} = {paths.VOL_ROWS}),
    fit AS (
      SELECT 0 AS round, ticker, 0.5::DOUBLE AS share0, 0.5::DOUBLE AS share1, avg(vol) - stddev_pop(vol) AS mean0,
             avg(vol) + stddev_pop(vol) AS mean1, var_pop(vol) + 1e-6 AS var0, var_pop(vol) + 1e-6 AS var1 FROM v GROUP BY ticker
      UNION ALL
      SELECT round + 1, ticker, sum(1 - p) / count(*), sum(p) / count(*), sum((1 - p) * vol) / sum(1 - p), sum(p * vol) / sum(p),
             greatest(sum((1 - p) * vol * vol) / sum(1 - p) - (sum((1 - p) * vol) / sum(1 - p)) ** 2, 0) + 1e-6,
             greatest(sum(p * vol * vol) / sum(p) - (sum(p * vol) / sum(p)) ** 2, 0) + 1e-6
      FROM (SELECT fit.*, vol, {upper_part("vol")} AS p FROM fit JOIN v USING (ticker) WHERE round < {REGIME_ROUNDS})
      GROUP BY round, ticker)
    SELECT ticker, bar_ts, {r("CASE WHEN mean1 >= mean0 THEN p ELSE 1 - p END", "wild_probability", 4)},
           CAST((CASE WHEN mean1 >= mean0 THEN p ELSE 1 - p END) > 0.5 AS INTEGER) AS regime
    FROM (SELECT ticker, bar_ts, mean0, mean1, {upper_part("log_ret")} AS p FROM v JOIN fit USING (ticker) WHERE round = {REGIME_ROUNDS})""",
)
def _(spark, sf):
    got = paths.vol_regime_per_key(return_line(spark, sf), rounds=REGIME_ROUNDS)
    return rounded(got.select("ticker", "bar_ts", "wild_probability", "regime"), 4)


@query(
    "vol_regime",
    f"""WITH RECURSIVE {RETURNS}, v AS MATERIALIZED (
      SELECT ticker, bar_ts, log_ret, stddev_samp(log_ret) {last_rows(paths.VOL_ROWS)} AS vol FROM lr
      QUALIFY count(log_ret) {last_rows(paths.VOL_ROWS)} = {paths.VOL_ROWS}),
    fit AS (
      SELECT 0 AS round, 0.5::DOUBLE AS share0, 0.5::DOUBLE AS share1, quantile_cont(vol, 0.25) AS mean0, quantile_cont(vol, 0.75) AS mean1,
             var_pop(vol) + 1e-6 AS var0, var_pop(vol) + 1e-6 AS var1, NULL::DOUBLE AS likely, NULL::DOUBLE AS before FROM v
      UNION ALL
      SELECT round + 1, sum(1 - p) / count(*), sum(p) / count(*), sum((1 - p) * vol) / sum(1 - p), sum(p * vol) / sum(p),
             greatest(sum((1 - p) * vol * vol) / sum(1 - p) - (sum((1 - p) * vol) / sum(1 - p)) ** 2, 0) + 1e-6,
             greatest(sum(p * vol * vol) / sum(p) - (sum(p * vol) / sum(p)) ** 2, 0) + 1e-6,
             avg(greatest(d0, d1) + ln(1 + exp(-abs(d0 - d1)))), any_value(likely)
      FROM (SELECT fit.*, vol, {upper_part("vol")} AS p, {regime_part("vol", 0)} AS d0, {regime_part("vol", 1)} AS d1 FROM fit, v
            WHERE round < 100 AND (before IS NULL OR likely - before >= 1e-3))
      GROUP BY round),
    last AS (SELECT * FROM fit ORDER BY round DESC LIMIT 1)
    SELECT ticker, bar_ts, {r("CASE WHEN mean1 >= mean0 THEN p ELSE 1 - p END", "wild_probability", 4)},
           CAST((CASE WHEN mean1 >= mean0 THEN p ELSE 1 - p END) > 0.5 AS INTEGER) AS regime,
           CASE WHEN (CASE WHEN mean1 >= mean0 THEN p ELSE 1 - p END) > 0.5 THEN 1.5::DOUBLE ELSE 0.8::DOUBLE END AS vol_weight
    FROM (SELECT ticker, bar_ts, mean0, mean1, {upper_part("log_ret")} AS p FROM v, last)""",
)
def _(spark, sf):
    got = paths.vol_regime(return_line(spark, sf))
    return rounded(got.select("ticker", "bar_ts", "wild_probability", "regime", "vol_weight"), 4)


STEPS = """st AS (SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
                        value AS price FROM events),
sl AS (SELECT path_id, regr_slope(price, step) AS slope FROM st GROUP BY 1)"""


def event_slopes(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    steps = Line.of(e, "user_id", ["ts", "event_id"]).with_position("step").result()
    return paths.path_slope(steps, "user_id", "step", "value").withColumnRenamed("user_id", "path_id")


@query("path_slope", f"WITH {STEPS} SELECT path_id, {r('slope')} FROM sl")
def _(spark, sf):
    return rounded(event_slopes(spark, sf))


@query(
    "path_forecast",
    f"""WITH {STEPS}
    SELECT {r("avg(CAST(slope > 0.01 / 1.5 AS INTEGER))", "up_prob")}, {r("avg(CAST(slope < -0.01 / 1.5 AS INTEGER))", "down_prob")},
           {r("tanh(avg(slope) * 10 * 1.5)", "trend_strength")},
           {r("quantile_cont(slope, 0.05)", "slope_p05")}, {r("quantile_cont(slope, 0.95)", "slope_p95")}
    FROM sl WHERE slope IS NOT NULL""",
)
def _(spark, sf):
    return rounded(paths.path_forecast(event_slopes(spark, sf), weight=1.5))


def strength_sql(h):
    return f"tanh(10 * avg(log_ret) FILTER (back <= {h})) AS s_{h}"


@query(
    "composite_signal",
    f"""WITH {RETURNS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) AS back FROM lr),
    v AS (SELECT ticker, stddev_samp(log_ret) FILTER (back <= 21) AS vol, {", ".join(strength_sql(h) for h in (5, 10, 21))} FROM k GROUP BY 1),
    w AS (SELECT *, exp(-5 / (vol * 100)) AS x5, exp(-10 / (vol * 100)) AS x10, exp(-21 / (vol * 100)) AS x21 FROM v)
    SELECT ticker, {r("vol")}, {rs({f"w_{h}": f"x{h} / (x5 + x10 + x21)" for h in (5, 10, 21)})},
           {r("greatest(-1, least(1, (x5 * s_5 + x10 * s_10 + x21 * s_21) / (x5 + x10 + x21)))", "signal")} FROM w""",
)
def _(spark, sf):
    ret = return_line(spark, sf).result().select("ticker", "bar_ts", "log_ret")
    vol = paths.recent_vol(ret, ["ticker"], ["bar_ts"])
    recent = S.tail_per_key(ret, ["ticker"], ["bar_ts"], max(paths.HORIZONS))
    line = Line.of(recent, "ticker", "bar_ts").with_position("at").whole({"n": F.count(F.lit(1))})
    back = F.col("n") - F.col("at")
    strengths = line.result().groupBy("ticker").agg(
        *[F.tanh(F.avg(F.when(back <= h, F.col("log_ret"))) * 10).alias(f"s_{h}") for h in paths.HORIZONS]
    )
    return rounded(paths.composite_signal(vol, strengths, ["ticker"]))


@query(
    "trend_score",
    f"""WITH {RETURNS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) AS back FROM lr),
    v AS (SELECT ticker, stddev_samp(log_ret) FILTER (back <= 21) AS vol FROM k GROUP BY 1),
    st AS (SELECT event_type AS ticker, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS step,
                  value FROM events),
    sl AS (SELECT ticker, h, user_id, regr_slope(value, step) AS slope FROM st JOIN (VALUES (5), (10), (21)) x(h) ON step <= h GROUP BY 1, 2, 3),
    f AS (SELECT ticker, {", ".join(f"tanh(10 * avg(slope) FILTER (h = {h})) AS s_{h}" for h in (5, 10, 21))} FROM sl GROUP BY 1),
    w AS (SELECT *, exp(-5 / (vol * 100)) AS x5, exp(-10 / (vol * 100)) AS x10, exp(-21 / (vol * 100)) AS x21 FROM v JOIN f USING (ticker))
    SELECT ticker, {r("vol")}, {rs({f"w_{h}": f"x{h} / (x5 + x10 + x21)" for h in (5, 10, 21)})},
           {r("greatest(-1, least(1, (x5 * s_5 + x10 * s_10 + x21 * s_21) / (x5 + x10 + x21)))", "signal")} FROM w""",
)
def _(spark, sf):
    """The slope strength of each horizon (a path: the first values of a user), weighted by recent volatility."""
    vol = paths.recent_vol(return_line(spark, sf).result().select("ticker", "bar_ts", "log_ret"), ["ticker"], ["bar_ts"])
    e = table(spark, sf, "events").select(F.col("event_type").alias("ticker"), "user_id", "ts", "event_id", "value")
    steps = Line.of(e, ["ticker", "user_id"], ["ts", "event_id"]).with_position("step").result()
    reached = F.filter(F.lit(list(paths.HORIZONS)), lambda h: F.col("step") <= h)
    slopes = paths.path_slope(steps.withColumn("h", F.explode(reached)), "user_id", "step", "value", ["ticker", "h"])
    strength = paths.path_forecast(slopes, ["ticker", "h"])
    wide = [F.max(F.when(F.col("h") == h, F.col("trend_strength"))).alias(f"s_{h}") for h in paths.HORIZONS]
    return rounded(paths.composite_signal(vol, strength.groupBy("ticker").agg(*wide), ["ticker"]))


# -- classifiers ---------------------------------------------------------------


ROW_KEY = ["ticker", "bar_ts"]
NUMBER = "('0x' || substr(md5(ticker || '|' || CAST(bar_ts AS VARCHAR)), 1, 8))::BIGINT"
BOOST_ROUNDS, BOOST_DEPTH = 5, 3


def grouped_features(spark, sf):
    """Rounded features of all tickers, a fifth of the rows by hash as test part."""
    d = rounded(I.feature_frame_grouped(bar_line(spark, sf)))
    key = F.concat_ws("|", "ticker", F.col("bar_ts").cast("string"))
    return written(S.split_by_hash(d, F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")), "grouped-features")


def timed_features(spark, sf):
    """Rounded full features, the last fifth of each ticker as test part."""
    frame = written(rounded(I.feature_frame(bar_line(spark, sf))), "timed-features")
    return S.split_by_time(Line.of(frame, "ticker", "bar_ts")).result()


def source(rows, features, label, key="0"):
    """Rows of a table as the tree SQL wants them."""
    return f"""src AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ticker, bar_ts) AS rid, {key} AS key,
      ticker || '|' || CAST(bar_ts AS VARCHAR) AS row_key, [{", ".join(f"{c}::DOUBLE" for c in features)}] AS x, {label} AS y,
      part = 'train' AS train, * FROM {rows})"""


SPLIT = f"""split AS MATERIALIZED (SELECT *, CASE WHEN {NUMBER} % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM ({GROUPED_SQL}))"""
TIMED = f"""split AS MATERIALIZED (SELECT *, CASE WHEN row_number() {OVER} - 1 < floor(0.8 * count(*) OVER (PARTITION BY ticker))
  THEN 'train' ELSE 'test' END AS part FROM ({FEATURE_SQL}))"""
POOLED = f"""WITH {SPLIT}, {source("split", I.GROUPED_FEATURES, "target")}, {tree_sql.forest(len(I.GROUPED_FEATURES))}"""
PER_TICKER = f"""WITH {SPLIT}, {source("split", I.GROUPED_FEATURES, "target", "ticker")}, {tree_sql.forest(len(I.GROUPED_FEATURES))}"""


def pooled_forest(d):
    return trees.forest(d.filter("part = 'train'"), I.GROUPED_FEATURES, "target", ROW_KEY)


@query(
    "ml_forest",
    f"""{POOLED} SELECT ticker, bar_ts, part, target, {r("probability")}, (probability > 0.5)::INT AS prediction FROM src JOIN wscore USING (rid)""",
)
def _(spark, sf):
    d = grouped_features(spark, sf)
    return rounded(pooled_forest(d).score(d).select("ticker", "bar_ts", "part", "target", "probability", "prediction"))


@query(
    "ml_forest_per_ticker",
    f"""{PER_TICKER} SELECT ticker, {r("avg((target = (probability > 0.5)::INT)::INT)", "accuracy")}, {r("avg(probability)", "mean_probability")}
    FROM src JOIN wscore USING (rid) WHERE part = 'test' GROUP BY 1""",
)
def _(spark, sf):
    """A forest of its own for each ticker, all grown together: as many jobs for ten thousand tickers as for five."""
    d = grouped_features(spark, sf)
    fitted = trees.forest(d.filter("part = 'train'"), I.GROUPED_FEATURES, "target", ROW_KEY, keys=["ticker"])
    test = written(fitted.score(d.filter("part = 'test'")), "per-ticker")
    mean = test.groupBy("ticker").agg(F.avg("probability").alias("mean_probability"))
    return rounded(decide.accuracy(test, "target", "prediction", ["ticker"]).join(mean, "ticker"))


@query(
    "ml_report",
    f"""{POOLED}, l AS (SELECT * FROM src JOIN wscore USING (rid) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) = 1)
    SELECT ticker, CASE WHEN probability > 0.5 THEN 'Buy' ELSE 'Sell' END AS recommendation, {r("probability")}, {r("close", "current_price")},
           {r("CASE WHEN probability <= 0.5 THEN close * 0.9 END", "reentry_price")} FROM l""",
)
def _(spark, sf):
    d = grouped_features(spark, sf)
    return rounded(decide.stocks_report(pooled_forest(d).score(d)))


GAINS = " UNION ALL ".join(f"SELECT tree, f, gain FROM w{k}s WHERE gain IS NOT NULL" for k in range(trees.FOREST_DEPTH))
NAMES = ", ".join(f"'{c}'" for c in I.GROUPED_FEATURES)


@query(
    "ml_forest_importance",
    f"""{POOLED}, g AS ({GAINS}), s AS (SELECT tree, f, gain / sum(gain) OVER (PARTITION BY tree) AS share FROM g),
    t AS (SELECT count(DISTINCT tree) AS n FROM g)
    SELECT [{NAMES}][f + 1] AS feature, {r("sum(share) / any_value(n)", "importance")} FROM range({len(I.GROUPED_FEATURES)}) x(f) LEFT JOIN s USING (f), t GROUP BY f""",
)
def _(spark, sf):
    return rounded(pooled_forest(grouped_features(spark, sf)).importances().select("feature", "importance"))


@query(
    "ml_contributions",
    f"""{POOLED}, {tree_sql.moves("w", trees.FOREST_DEPTH)},
    s AS (SELECT rid, f, sum(moved) / {trees.TREES} AS c FROM wmoves GROUP BY 1, 2)
    SELECT [{NAMES}][f + 1] AS feature, {r("sum(abs(c)) / (SELECT count(*) FROM src WHERE part = 'test')", "importance")}
    FROM s JOIN src USING (rid) WHERE part = 'test' GROUP BY f ORDER BY importance DESC, feature LIMIT 5""",
)
def _(spark, sf):
    """The five features that move the chance of the test rows most, by the steps of all trees."""
    d = grouped_features(spark, sf)
    moved = pooled_forest(d).contributions(d.filter("part = 'test'"))
    named = moved.select([F.col(f"c_{c}").alias(c) for c in I.GROUPED_FEATURES])
    return rounded(decide.importance_rank(named, I.GROUPED_FEATURES, 5))


#: A small tree by hand, as ``operators.trees`` writes them: tree, node, feature, threshold, left, right, value.
HAND_MADE = [
    (0, 0, 0, 25.0, 1, 2, 0.5), (0, 1, 1, 1100.0, 3, 4, 0.3), (0, 2, None, None, None, None, 0.8),
    (0, 3, None, None, None, None, 0.1), (0, 4, None, None, None, None, 0.45),
    (1, 0, 1, 1000.5, 1, 2, 0.5), (1, 1, None, None, None, None, 0.2), (1, 2, 0, 10.0, 3, 4, 0.6),
    (1, 3, None, None, None, None, 0.55), (1, 4, None, None, None, None, 0.9),
]


@query(
    "tree_score",
    f"""WITH RECURSIVE n(tree, node, feature, threshold, l, r, value) AS (VALUES {", ".join("(" + ", ".join("NULL" if c is None else str(c) for c in row) + ")" for row in HAND_MADE)}),
    walk AS (
      SELECT p_partkey, [p_size::DOUBLE, p_retailprice::DOUBLE] AS x, tree, 0 AS place FROM part, (SELECT DISTINCT tree FROM n)
      UNION ALL
      SELECT p_partkey, x, walk.tree, CASE WHEN x[feature + 1] > threshold THEN r ELSE l END FROM walk JOIN n ON n.tree = walk.tree AND n.node = place
      WHERE feature IS NOT NULL)
    SELECT p_partkey, {r("avg(value)", "probability")}, (avg(value) > 0.5)::INT AS prediction
    FROM walk JOIN n ON n.tree = walk.tree AND n.node = place AND feature IS NULL GROUP BY 1""",
)
def _(spark, sf):
    nodes = spark.createDataFrame(HAND_MADE, "tree int, node int, feature int, threshold double, left int, right int, value double")
    model = trees.Trees(nodes, ("p_size", "p_retailprice"), depth=2)
    return rounded(model.score(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")).select("p_partkey", "probability", "prediction"))


BOOSTED = f"""WITH {TIMED}, {source("split", I.FEATURES, "up_next")}, {tree_sql.boost(len(I.FEATURES), BOOST_ROUNDS, BOOST_DEPTH)}"""


@query(
    "ml_boost",
    f"""{BOOSTED} SELECT ticker, bar_ts, up_next, {r("probability")}, (probability > 0.5)::INT AS prediction
    FROM src JOIN zscore USING (rid) WHERE part = 'test'""",
)
def _(spark, sf):
    d = timed_features(spark, sf)
    fitted = trees.boost(d.filter("part = 'train'"), I.FEATURES, "up_next", rounds=BOOST_ROUNDS, depth=BOOST_DEPTH)
    return rounded(fitted.score(d.filter("part = 'test'")).select("ticker", "bar_ts", "up_next", "probability", "prediction"))


@query(
    "accuracy",
    f"""WITH {BARS}, t AS (SELECT ticker, CAST(coalesce(lead(close) {OVER} > close, false) AS INTEGER) AS y,
                                  CAST(close > open AS INTEGER) AS p FROM bars)
    SELECT ticker, {r("avg(CAST(y = p AS INTEGER))", "accuracy")} FROM t GROUP BY 1""",
)
def _(spark, sf):
    d = S.target_next(bar_line(spark, sf)).result().withColumn("p", (F.col("close") > F.col("open")).cast("int"))
    return rounded(decide.accuracy(d, "target", "p", ["ticker"]))


@query(
    "importance_rank",
    f"""SELECT * FROM (
      SELECT 'p_size' AS feature, {r("avg(abs(p_size - 25))", "importance")} FROM part
      UNION ALL SELECT 'p_retailprice', round(avg(abs(p_retailprice - 1000)), 6) + 0.0 FROM part
      UNION ALL SELECT 'p_partkey', round(avg(abs(p_partkey * -0.001)), 6) + 0.0 FROM part)
    ORDER BY importance DESC LIMIT 2""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select(
        (F.col("p_size") - 25).alias("p_size"),
        (F.col("p_retailprice") - 1000).alias("p_retailprice"),
        (F.col("p_partkey") * -0.001).alias("p_partkey"),
    )
    return rounded(decide.importance_rank(p, ["p_size", "p_retailprice", "p_partkey"], 2))


SEQUENCE = {**{f"first_{c}": (c, 60) for c in I.FEATURES}, **{f"last_{c}": (c, 1) for c in I.FEATURES}}


@query(
    "sequence_features",
    f"""WITH x AS ({FEATURE_SQL}), n AS (
      SELECT *, row_number() {OVER} - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n, lag(up_next) {OVER} AS sequence_label,
             {", ".join(f"lag({c}, {back}) {OVER} AS {name}" for name, (c, back) in SEQUENCE.items())} FROM x)
    SELECT ticker, bar_ts, CASE WHEN i - 1 < floor(0.8 * n) THEN 'train' ELSE 'test' END AS part, sequence_label,
           60 AS steps, {len(I.FEATURES)} AS width, {", ".join(SEQUENCE)} FROM n WHERE i >= 60""",
)
def _(spark, sf):
    """Sequences of 60 rows of all features; a sequence is in the part in which the row of its label stands."""
    frame = written(rounded(I.feature_frame(bar_line(spark, sf))), "sequence-features")
    line = S.split_by_time(Line.of(frame, "ticker", "bar_ts"))
    line = line.roll(lambda d, f: d.withColumn("part", S.shift(F.col("part"), 1, f)), before=1)
    s = F.col("sequence")
    places = {name: s[60 - back][I.FEATURES.index(c)].alias(name) for name, (c, back) in SEQUENCE.items()}
    seq = S.sequence_windows(line, list(I.FEATURES), "up_next").result()
    return seq.select("ticker", "bar_ts", "part", "sequence_label", F.size(s).alias("steps"), F.size(s[0]).alias("width"), *places.values())


# -- decisions -------------------------------------------------------------------

CHANCES = f"""{BARS},
a AS (SELECT ticker, bar_ts, (close - low + 1) / (high - low + 2) AS p FROM bars),
c AS (SELECT ticker, bar_ts, volume / (volume + close + 1) AS p FROM bars),
e AS (SELECT ticker, bar_ts, a.p AS p_first, c.p AS p_second, (a.p + c.p) / 2 AS p_up FROM a JOIN c USING (ticker, bar_ts))"""


def chances(spark, sf):
    b = bars(spark, sf)
    first = (F.col("close") - F.col("low") + 1) / (F.col("high") - F.col("low") + 2)
    second = F.col("volume") / (F.col("volume") + F.col("close") + 1)
    a = b.select("ticker", "bar_ts", first.alias("p"))
    c = b.select("ticker", "bar_ts", second.alias("p"))
    return decide.ensemble_kelly(a, c, ["ticker", "bar_ts"])


@query(
    "ensemble_kelly",
    f"""WITH {CHANCES} SELECT ticker, bar_ts, {rs(["p_first", "p_second", "p_up"])}, {r("2 * p_up - 1", "kelly")} FROM e""",
)
def _(spark, sf):
    return rounded(chances(spark, sf))


@query(
    "verdict",
    f"""WITH {CHANCES}, k AS (SELECT ticker, bar_ts, 2 * p_up - 1 AS kelly FROM e)
    SELECT ticker, bar_ts, CASE WHEN kelly > 0.5 THEN 'Strong Buy' WHEN kelly > 0.1 THEN 'Buy' WHEN kelly < -0.5 THEN 'Strong Sell'
                                WHEN kelly < -0.1 THEN 'Sell' ELSE 'Hold/Neutral' END AS verdict FROM k""",
)
def _(spark, sf):
    return chances(spark, sf).select("ticker", "bar_ts", decide.verdict(F.col("kelly")).alias("verdict"))


@query(
    "verdict_latest",
    f"""WITH {CHANCES}, k AS (SELECT ticker, bar_ts, 2 * p_up - 1 AS kelly, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) AS back FROM e)
    SELECT ticker, bar_ts, {r("kelly")}, CASE WHEN kelly > 0.5 THEN 'Strong Buy' WHEN kelly > 0.1 THEN 'Buy' WHEN kelly < -0.5 THEN 'Strong Sell'
                                WHEN kelly < -0.1 THEN 'Sell' ELSE 'Hold/Neutral' END AS verdict FROM k WHERE back = 1""",
)
def _(spark, sf):
    last = decide.latest(chances(spark, sf), ["ticker"], ["bar_ts"])
    return rounded(last.select("ticker", "bar_ts", "kelly", decide.verdict(F.col("kelly")).alias("verdict")))


@query(
    "signal_points",
    f"""WITH {NUMBERED}, t AS (SELECT *, i >= floor(0.8 * count(*) OVER (PARTITION BY ticker)) AS test FROM b)
    SELECT ticker, bar_ts, close, CASE WHEN close > open THEN 'buy' ELSE 'sell' END AS side FROM t WHERE test""",
)
def _(spark, sf):
    test = S.split_by_time(bar_line(spark, sf)).result().filter("part = 'test'")
    predicted = test.select("ticker", "bar_ts", (F.col("close") > F.col("open")).cast("int").alias("prediction"))
    return decide.signal_points(bars(spark, sf), predicted, ["ticker", "bar_ts"])


@query(
    "main_verdict",
    f"""{BOOSTED}, {tree_sql.forest(len(I.FEATURES))},
    l AS (SELECT * FROM src WHERE part = 'test' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) = 1),
    e AS (SELECT ticker, bar_ts, zscore.probability AS p_first, wscore.probability AS p_second,
                 (zscore.probability + wscore.probability) / 2 AS p_up FROM l JOIN zscore USING (rid) JOIN wscore USING (rid)),
    k AS (SELECT *, 2 * p_up - 1 AS kelly FROM e)
    SELECT ticker, bar_ts, {rs(["p_first", "p_second", "p_up", "kelly"])},
           CASE WHEN kelly > 0.5 THEN 'Strong Buy' WHEN kelly > 0.1 THEN 'Buy' WHEN kelly < -0.5 THEN 'Strong Sell'
                WHEN kelly < -0.1 THEN 'Sell' ELSE 'Hold/Neutral' END AS verdict FROM k""",
)
def _(spark, sf):
    """Features, two models on the earlier part, their mean chance on the later part, stake and verdict of the last row."""
    d = timed_features(spark, sf)
    train, last = d.filter("part = 'train'"), decide.latest(d.filter("part = 'test'"), ["ticker"], ["bar_ts"])
    boosted = trees.boost(train, I.FEATURES, "up_next", rounds=BOOST_ROUNDS, depth=BOOST_DEPTH)
    forest = trees.forest(train, I.FEATURES, "up_next", ROW_KEY)
    first, second = (m.score(last).select(*ROW_KEY, F.col("probability").alias("p")) for m in (boosted, forest))
    both = decide.ensemble_kelly(first, second, ROW_KEY)
    return rounded(both.withColumn("verdict", decide.verdict(F.col("kelly"))))


def taken(k, spent):
    """Shares of the k-th offer, and whether it fits, as SQL."""
    shares = f"greatest(CAST(round((100 - {spent} - fmod(100 - {spent}, price{k})) / price{k}) AS BIGINT), 1)"
    return f"""CASE WHEN price{k} IS NOT NULL AND {spent} + {shares} * price{k} <= 100 THEN {shares} END AS n{k}"""


def bought_sql(offers, key, item):
    """The three likeliest offers of each key, bought one after the other within 100, as SQL (key, item, probability, price, shares)."""
    wide = ", ".join(f"max({c}) FILTER (k = {k}) AS {n}{k}" for k in (1, 2, 3) for c, n in ((item, "item"), ("probability", "prob"), ("price", "price")))
    each = " UNION ALL ".join(
        f"SELECT {key}, item{k} AS {item}, prob{k} AS probability, price{k} AS price, n{k} AS shares FROM t3 WHERE n{k} IS NOT NULL" for k in (1, 2, 3)
    )
    return f"""w AS (SELECT {key}, {wide} FROM {offers} GROUP BY 1),
    t1 AS (SELECT *, {taken(1, "0.0::DOUBLE")} FROM w),
    s1 AS (SELECT *, coalesce(n1 * price1, 0.0) AS spent1 FROM t1),
    t2 AS (SELECT *, {taken(2, "spent1")} FROM s1),
    s2 AS (SELECT *, spent1 + coalesce(n2 * price2, 0.0) AS spent2 FROM t2),
    t3 AS (SELECT *, {taken(3, "spent2")} FROM s2),
    u AS ({each})"""


@query(
    "pooled_predictor",
    f"""{POOLED}, l AS (SELECT * FROM src JOIN wscore USING (rid) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) = 1),
    o AS (SELECT 0 AS every, ticker, probability, close AS price, row_number() OVER (ORDER BY probability DESC, ticker) AS k FROM l),
    {bought_sql("o", "every", "ticker")}
    SELECT ticker, {r("probability")}, {r("price", "close")}, shares, {r("shares * price", "cost")} FROM u""",
)
def _(spark, sf):
    """Features of all tickers, one forest, the last row of each, the three likeliest bought while the budget lasts."""
    frame = grouped_features(spark, sf)
    last = pooled_forest(frame).score(decide.latest(frame, ["ticker"], ["bar_ts"])).select("ticker", "probability", "close")
    bought = decide.budget_allocate(last, [], "ticker", "probability", "close", budget=100.0, k=3)
    return rounded(bought.select("ticker", "probability", F.col("price").alias("close"), "shares", "cost"))


@query(
    "budget_allocate",
    f"""WITH o AS (SELECT p_brand, p_partkey, p_size / 50 AS probability, p_retailprice / 40 AS price,
                   row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part),
    {bought_sql("o", "p_brand", "p_partkey")}
    SELECT p_brand, p_partkey, {rs(["probability", "price"])}, shares, {r("shares * price", "cost")} FROM u""",
)
def _(spark, sf):
    offers = table(spark, sf, "part").select(
        "p_brand", "p_partkey", (F.col("p_size") / 50).alias("probability"), (F.col("p_retailprice") / 40).alias("price")
    )
    return rounded(decide.budget_allocate(offers, ["p_brand"], "p_partkey", "probability", "price"))
