"""Technical indicators and the two feature tables."""

from pyspark.sql import functions as F

from weftline.catalog.registry import NUMBERED, OVER, bar_line, guarded, query, rounded, rs, split_line
from weftline.operators import decide
from weftline.operators import indicators as I

VALUES = ("open", "high", "low", "close", "volume")

# One table (ticker, i, outputs) per indicator, as SQL.
NEXT = "JOIN b ON b.ticker = y.ticker AND b.i = y.i + 1"
PARTS = {
    "rsi_wilder": (
        ["rsi"],
        f"""moves AS MATERIALIZED (SELECT ticker, i, close - lag(close) {OVER} AS d FROM b),
    smooth AS (
      SELECT ticker, i, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM moves WHERE i = 1
      UNION ALL SELECT m.ticker, m.i, y.g * 13 / 14 + greatest(d, 0) / 14, y.l * 13 / 14 + greatest(-d, 0) / 14
      FROM smooth y JOIN moves m ON m.ticker = y.ticker AND m.i = y.i + 1),
    rsi_wilder AS (SELECT ticker, i, CASE WHEN l <> 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100.0 END AS rsi
                   FROM b LEFT JOIN smooth USING (ticker, i))""",
    ),
    "macd": (
        ["macd_line", "macd_signal", "macd_hist"],
        f"""emas AS (
      SELECT ticker, i, close AS f, close AS s FROM b WHERE i = 0
      UNION ALL SELECT b.ticker, b.i, y.f * 11 / 13 + b.close * 2 / 13, y.s * 25 / 27 + b.close * 2 / 27 FROM emas y {NEXT}),
    ml AS MATERIALIZED (SELECT ticker, i, f - s AS line FROM emas),
    ms AS (
      SELECT ticker, i, line AS sig FROM ml WHERE i = 0
      UNION ALL SELECT m.ticker, m.i, y.sig * 0.8 + m.line * 0.2 FROM ms y JOIN ml m ON m.ticker = y.ticker AND m.i = y.i + 1),
    macd AS (SELECT ticker, i, line AS macd_line, sig AS macd_signal, line - sig AS macd_hist FROM ml JOIN ms USING (ticker, i))""",
    ),
    "macd_adjusted": (
        ["macd_line", "macd_signal"],
        f"""aemas AS (
      SELECT ticker, i, close AS f, 1::DOUBLE AS fm, close AS s, 1::DOUBLE AS sm FROM b WHERE i = 0
      UNION ALL SELECT b.ticker, b.i, y.f * 11 / 13 + b.close, y.fm * 11 / 13 + 1, y.s * 25 / 27 + b.close, y.sm * 25 / 27 + 1
      FROM aemas y {NEXT}),
    aml AS MATERIALIZED (SELECT ticker, i, f / fm - s / sm AS line FROM aemas),
    ams AS (
      SELECT ticker, i, line AS n, 1::DOUBLE AS m FROM aml WHERE i = 0
      UNION ALL SELECT a.ticker, a.i, y.n * 0.8 + a.line, y.m * 0.8 + 1 FROM ams y JOIN aml a ON a.ticker = y.ticker AND a.i = y.i + 1),
    macd_adjusted AS (SELECT ticker, i, line AS macd_line, n / m AS macd_signal FROM aml JOIN ams USING (ticker, i))""",
    ),
    "rsi_sma": (
        ["rsi"],
        f"""ups AS (SELECT ticker, bar_ts, i, coalesce(greatest(close - lag(close) {OVER}, 0), 0.0) AS u,
                       coalesce(greatest(lag(close) {OVER} - close, 0), 0.0) AS v FROM b),
    means AS (SELECT ticker, i, {guarded("avg", "u", 14)} AS g, {guarded("avg", "v", 14)} AS l FROM ups),
    rsi_sma AS (SELECT ticker, i, CASE WHEN l <> 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100.0 END AS rsi FROM means)""",
    ),
    "atr": (
        ["atr"],
        f"""tr AS (SELECT ticker, bar_ts, i, greatest(high - low, abs(high - lag(close) {OVER}), abs(low - lag(close) {OVER})) AS t FROM b),
    atr AS (SELECT ticker, i, {guarded("avg", "t", 14)} AS atr FROM tr)""",
    ),
    "atr_simple": (
        ["atr"],
        f"""hl AS (SELECT ticker, bar_ts, i, high - low AS t FROM b),
    atr_simple AS (SELECT ticker, i, {guarded("avg", "t", 14)} AS atr FROM hl)""",
    ),
    "bollinger": (
        ["bb_mid", "bb_upper", "bb_lower"],
        f"""mid AS (SELECT ticker, i, {guarded("avg", "close", 20)} AS m, {guarded("stddev_samp", "close", 20)} AS s FROM b),
    bollinger AS (SELECT ticker, i, m AS bb_mid, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower FROM mid)""",
    ),
    "obv": (
        ["obv"],
        f"""flow AS (SELECT ticker, bar_ts, i, coalesce(sign(close - lag(close) {OVER}), 0) * volume AS q FROM b),
    obv AS (SELECT ticker, i, sum(q) {OVER} AS obv FROM flow)""",
    ),
    "stochastic": (
        ["stoch_k", "stoch_d"],
        f"""rng AS (SELECT ticker, bar_ts, i, close, {guarded("min", "low", 14)} AS lo, {guarded("max", "high", 14)} AS hi FROM b),
    ks AS (SELECT ticker, bar_ts, i, (close - lo) / (hi - lo + 1e-9) * 100 AS stoch_k FROM rng),
    stochastic AS (SELECT ticker, i, stoch_k, {guarded("avg", "stoch_k", 3)} AS stoch_d FROM ks)""",
    ),
    "stochastic_plain": (
        ["stoch_k", "stoch_d"],
        f"""prng AS (SELECT ticker, bar_ts, i, close, {guarded("min", "low", 14)} AS lo, {guarded("max", "high", 14)} AS hi FROM b),
    pks AS (SELECT ticker, bar_ts, i, (close - lo) / nullif(hi - lo, 0) * 100 AS stoch_k FROM prng),
    stochastic_plain AS (SELECT ticker, i, stoch_k, {guarded("avg", "stoch_k", 3)} AS stoch_d FROM pks)""",
    ),
    "mfi": (
        ["mfi"],
        f"""tps AS (SELECT ticker, bar_ts, i, volume, (high + low + close) / 3 AS tp FROM b),
    tpd AS (SELECT *, tp - lag(tp) {OVER} AS d FROM tps),
    flows AS (SELECT ticker, bar_ts, i, CASE WHEN d > 0 THEN tp * volume ELSE 0 END AS p, CASE WHEN d < 0 THEN tp * volume ELSE 0 END AS n FROM tpd),
    mfi AS (SELECT ticker, i, 100 - 100 / (1 + {guarded("sum", "p", 14)} / ({guarded("sum", "n", 14)} + 1e-9)) AS mfi FROM flows)""",
    ),
    "cci": (
        ["cci"],
        f"""ctp AS (SELECT ticker, bar_ts, i, (high + low + close) / 3 AS tp FROM b),
    dev AS (SELECT ticker, bar_ts, i, tp - {guarded("avg", "tp", 20)} AS d FROM ctp),
    absd AS (SELECT ticker, bar_ts, i, d, abs(d) AS a FROM dev),
    cci AS (SELECT ticker, i, d / nullif(0.015 * {guarded("avg", "a", 20)}, 0) AS cci FROM absd)""",
    ),
    "williams_r": (
        ["williams_r"],
        f"""wr AS (SELECT ticker, i, close, {guarded("min", "low", 14)} AS lo, {guarded("max", "high", 14)} AS hi FROM b),
    williams_r AS (SELECT ticker, i, (hi - close) / (hi - lo + 1e-9) * -100 AS williams_r FROM wr)""",
    ),
    "roc": (["roc"], f"roc AS (SELECT ticker, i, (close / nullif(lag(close, 10) {OVER}, 0) - 1) * 100 AS roc FROM b)"),
    "garch_vol": (
        ["garch_vol"],
        f"""rets AS (SELECT ticker, i, coalesce(close / nullif(lag(close) {OVER}, 0) - 1, 0) AS r FROM b),
    lev AS MATERIALIZED (SELECT ticker, i, r, var_samp(r) OVER (PARTITION BY ticker) AS v0 FROM rets),
    gv AS (
      SELECT ticker, i, v0 AS v FROM lev WHERE i = 0
      UNION ALL SELECT x.ticker, x.i, x.v0 * (1 - 0.1::DOUBLE - 0.85::DOUBLE) + 0.1 * x.r * x.r + 0.85 * y.v
      FROM gv y JOIN lev x ON x.ticker = y.ticker AND x.i = y.i + 1),
    garch_vol AS (SELECT ticker, i, sqrt(v) AS garch_vol FROM gv)""",
    ),
    "dominant_period": (
        ["dominant_period"],
        f"""held AS (SELECT a.ticker, a.i, k.i - a.i + 60 AS j, k.close - avg(k.close) OVER (PARTITION BY a.ticker, a.i) AS c
             FROM b a JOIN b k ON k.ticker = a.ticker AND k.i BETWEEN a.i - 60 AND a.i - 1 WHERE a.i >= 60),
    tap AS (SELECT ticker, i, j, c * (0.54 - 0.46 * cos(2 * pi() * j / 59)) AS x FROM held),
    power AS (SELECT ticker, i, f, pow(sum(x * cos(2 * pi() * f * j / 60)), 2) + pow(sum(x * sin(2 * pi() * f * j / 60)), 2) AS pw
              FROM tap, range(1, 30) fs(f) GROUP BY 1, 2, 3),
    peaks AS (SELECT *, coalesce(pw > lag(pw) OVER q AND pw > lead(pw) OVER q, false) AS peak
              FROM power WINDOW q AS (PARTITION BY ticker, i ORDER BY f)),
    noise AS (SELECT ticker, i, median(pw) FILTER (NOT peak) AS level FROM peaks GROUP BY 1, 2),
    best AS (SELECT p.ticker, p.i, f, row_number() OVER (PARTITION BY p.ticker, p.i ORDER BY pw DESC) AS place
             FROM peaks p JOIN noise n ON n.ticker = p.ticker AND n.i = p.i WHERE peak AND pw > 2 * level),
    raw AS (SELECT b.ticker, b.i, b.bar_ts, 60.0::DOUBLE / max(f) AS d
            FROM b LEFT JOIN best s ON s.ticker = b.ticker AND s.i = b.i AND place <= 3 GROUP BY 1, 2, 3),
    ends AS (SELECT *, last_value(d IGNORE NULLS) {OVER[:-1]} ROWS UNBOUNDED PRECEDING) AS lo,
        last_value(CASE WHEN d IS NOT NULL THEN i END IGNORE NULLS) {OVER[:-1]} ROWS UNBOUNDED PRECEDING) AS lo_i,
        first_value(d IGNORE NULLS) {OVER[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi,
        first_value(CASE WHEN d IS NOT NULL THEN i END IGNORE NULLS)
          {OVER[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi_i FROM raw),
    filled AS (SELECT ticker, i, bar_ts, CASE WHEN d IS NOT NULL THEN d ELSE lo + (hi - lo) * (i - lo_i) / (hi_i - lo_i) END AS d FROM ends),
    dominant_period AS (SELECT ticker, i, avg(d) {OVER[:-1]} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS dominant_period FROM filled)""",
    ),
    "return1": (
        ["return1"],
        f"return1 AS (SELECT ticker, i, coalesce(close / nullif(lag(close) {OVER}, 0) - 1, 0) * 100 AS return1 FROM b)",
    ),
}


def part_sql(name):
    outs, sql = PARTS[name]
    return f"WITH RECURSIVE {NUMBERED}, {sql} SELECT ticker, bar_ts, {rs(outs)} FROM b JOIN {name} USING (ticker, i)"


def slim(line):
    return rounded(line.map(lambda d: d.drop(*VALUES)).result())


SINGLE = {
    "rsi_wilder": lambda: I.rsi("wilder"),
    "rsi_sma": lambda: I.rsi("sma"),
    "macd": lambda: I.macd("recursive"),
    "macd_adjusted": lambda: I.macd("adjusted"),
    "atr": lambda: I.atr("true_range"),
    "atr_simple": lambda: I.atr("simple"),
    "bollinger": I.bollinger,
    "stochastic": lambda: I.stochastic("guarded"),
    "stochastic_plain": lambda: I.stochastic("plain"),
    "mfi": I.mfi,
    "cci": I.cci,
    "williams_r": I.williams_r,
    "roc": I.roc,
    "return1": I.return1,
}
WHOLE = {"obv": I.obv, "garch_vol": I.garch_vol, "dominant_period": I.dominant_period}


def register_single(name, make):
    @query(name, part_sql(name))
    def _(spark, sf):
        return slim(I.add(bar_line(spark, sf), make()))


def register_whole(name, fn):
    @query(name, part_sql(name))
    def _(spark, sf):
        return slim(fn(bar_line(spark, sf)))


for _name, _make in SINGLE.items():
    register_single(_name, _make)
for _name, _fn in WHOLE.items():
    register_whole(_name, _fn)


FULL_PARTS = ("rsi_wilder", "macd", "atr", "bollinger", "obv", "stochastic", "mfi", "cci", "williams_r", "roc",
              "garch_vol", "dominant_period", "return1")
GROUPED_PARTS = ("macd_adjusted", "rsi_sma", "atr_simple", "bollinger", "obv", "stochastic_plain")


def joined(parts):
    return " ".join(f"JOIN {p} USING (ticker, i)" for p in parts)


def known(columns):
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


FEATURE_SQL = f"""WITH RECURSIVE {NUMBERED}, {", ".join(PARTS[p][1] for p in FULL_PARTS)},
    every AS (SELECT * FROM b {joined(FULL_PARTS)}),
    whole AS (SELECT * FROM every WHERE {known(I.FEATURES)})
    SELECT ticker, bar_ts, {rs(["open", "high", "low", *I.FEATURES])},
           CAST(coalesce(lead(close) {OVER} > close, false) AS INTEGER) AS up_next FROM whole"""


@query("feature_frame", FEATURE_SQL)
def _(spark, sf):
    return rounded(I.feature_frame(bar_line(spark, sf)))


@query("feature_frame_blocks", FEATURE_SQL)
def _(spark, sf):
    return rounded(I.feature_frame(split_line(spark, sf)))


GROUPED_SQL = f"""WITH RECURSIVE {NUMBERED}, {", ".join(PARTS[p][1] for p in GROUPED_PARTS)},
    every AS (SELECT *, CAST(coalesce(lead(close, 5) {OVER} > close, false) AS INTEGER) AS target FROM b {joined(GROUPED_PARTS)})
    SELECT ticker, bar_ts, {rs([*VALUES, "bb_mid", *I.GROUPED_FEATURES])}, target FROM every WHERE {known(I.GROUPED_FEATURES)}"""


@query("feature_frame_grouped", GROUPED_SQL)
def _(spark, sf):
    return rounded(I.feature_frame_grouped(bar_line(spark, sf)))


@query(
    "stocks_report",
    f"""WITH {NUMBERED}, m AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) AS back FROM b)
    SELECT ticker, CASE WHEN close > open THEN 'Buy' ELSE 'Sell' END AS recommendation,
           {rs({"probability": "close / (close + open)"})}, close AS current_price,
           {rs({"reentry_price": "CASE WHEN close <= open THEN close * 0.9 END"})} FROM m WHERE back = 1""",
)
def _(spark, sf):
    scored = bar_line(spark, sf).result().withColumns(
        {
            "prediction": (F.col("close") > F.col("open")).cast("int"),
            "probability": F.col("close") / (F.col("close") + F.col("open")),
        }
    )
    return rounded(decide.stocks_report(scored))
