"""Window and series operators on bars."""

from pyspark.sql import functions as F

from weftline.catalog.registry import (
    BARS,
    NUMBERED,
    OVER,
    bar_line,
    bars,
    grid_line,
    guarded,
    query,
    r,
    rounded,
    rs,
    table,
    ORACLES,
    split_line,
)
from weftline.catalog.registry import GRID as GRID_SQL
from weftline.operators import indicators as I
from weftline.operators import series as S

VALUES = ("open", "high", "low", "close", "volume")


def only(d, *names, **cols):
    """Keep the labels (and what the line needs), drop bar values, add columns."""
    gone = [v for v in VALUES if v not in names]
    return d.withColumns(cols).drop(*gone)


@query(
    "rolling",
    f"WITH {BARS} SELECT ticker, bar_ts, "
    + rs({f"{n}{k}": guarded(a, "close", k) for n, a, k in (
        ("mean", "avg", 20), ("std", "stddev_samp", 20), ("min", "min", 14), ("max", "max", 14), ("sum", "sum", 5))})
    + " FROM bars",
)
def _(spark, sf):
    c = F.col("close")

    def build(d, f):
        kinds = (("mean", 20), ("std", 20), ("min", 14), ("max", 14), ("sum", 5))
        return only(d.withColumns({f"{h}{n}": S.rolling(c, n, h, f) for h, n in kinds}))

    return rounded(bar_line(spark, sf).roll(build, before=20).result())


@query(
    "rolling_gaps",
    f"WITH {GRID_SQL} SELECT ticker, bar_ts, {r(guarded('avg', 'close', 4), 'mean4')} FROM grid",
)
def _(spark, sf):
    return rounded(
        grid_line(spark, sf)
        .roll(lambda d, f: only(d.withColumn("mean4", S.rolling(F.col("close"), 4, "mean", f))), before=4)
        .result()
    )


@query(
    "rolling_centered",
    f"""WITH {BARS} SELECT ticker, bar_ts,
        {r(f"avg(close) {OVER[:-1]} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", "mean")} FROM bars""",
)
def _(spark, sf):
    return rounded(
        bar_line(spark, sf)
        .roll(lambda d, f: only(d.withColumn("mean", S.rolling_centered(F.col("close"), 3, "mean", f))), 1, 1)
        .result()
    )


@query("diff", f"WITH {BARS} SELECT ticker, bar_ts, {r(f'close - lag(close) {OVER}', 'change')} FROM bars")
def _(spark, sf):
    return rounded(
        bar_line(spark, sf).roll(lambda d, f: only(d.withColumn("change", S.diff(F.col("close"), f))), 1).result()
    )


@query(
    "pct_change",
    f"""WITH {BARS} SELECT ticker, bar_ts, {r(f"close / nullif(lag(close) {OVER}, 0) - 1", "one")},
        {r(f"close / nullif(lag(close, 10) {OVER}, 0) - 1", "ten")} FROM bars""",
)
def _(spark, sf):
    def build(d, f):
        c = F.col("close")
        return only(d.withColumns({"one": S.pct_change(c, f), "ten": S.pct_change(c, f, 10)}))

    return rounded(bar_line(spark, sf).roll(build, 10).result())


LOG_RET = f"CASE WHEN close > 0 AND lag(close) {OVER} > 0 THEN ln(close / lag(close) {OVER}) END"


@query("log_return", f"WITH {BARS} SELECT ticker, bar_ts, {r(LOG_RET, 'log_ret')} FROM bars")
def _(spark, sf):
    return rounded(
        bar_line(spark, sf).roll(lambda d, f: only(d.withColumn("log_ret", S.log_return(F.col("close"), f))), 1).result()
    )


@query(
    "cumsum",
    f"""WITH {GRID_SQL} SELECT ticker, bar_ts,
        {r(f"CASE WHEN close IS NOT NULL THEN sum(close) {OVER} END", "total", 4)} FROM grid""",
)
def _(spark, sf):
    line = S.cumsum(grid_line(spark, sf), {"total": F.col("close")})
    return rounded(line.map(lambda d: d.drop(*VALUES)).result(), 4)


def recursive(name, start, step):
    """One value per bar from the bar before."""
    return f"""{name} AS (
      SELECT ticker, i, {start} FROM b WHERE i = 0
      UNION ALL SELECT b.ticker, b.i, {step} FROM {name} y JOIN b ON b.ticker = y.ticker AND b.i = y.i + 1)"""


@query(
    "ewm_recursive",
    f"""WITH RECURSIVE {NUMBERED}, {recursive("e", "close AS e12, close AS e26, close AS a14",
        "y.e12 * 11 / 13 + b.close * 2 / 13, y.e26 * 25 / 27 + b.close * 2 / 27, y.a14 * 13 / 14 + b.close / 14")}
    SELECT ticker, bar_ts, {rs(["e12", "e26", "a14"])} FROM b JOIN e USING (ticker, i)""",
)
def _(spark, sf):
    c = F.col("close")
    terms = {"e12": (c, S.alpha_of(span=12)), "e26": (c, S.alpha_of(span=26)), "a14": (c, S.alpha_of(alpha=1 / 14))}
    return rounded(S.ewm(bar_line(spark, sf), terms, adjust=False).map(lambda d: d.drop(*VALUES)).result())


def over_gaps(name, source, column, alpha):
    """Recursive mean over a series with gaps, as SQL: the weight of the mean so far shrinks with every row."""
    q = f"(1 - {alpha})"
    return f"""{name} AS (
      SELECT ticker, i, {column} AS y, 1.0::DOUBLE AS w FROM {source} WHERE i = 0
      UNION ALL SELECT v.ticker, v.i,
        CASE WHEN v.{column} IS NULL THEN y.y WHEN y.y IS NULL THEN v.{column}
             ELSE (y.w * {q} * y.y + {alpha} * v.{column}) / (y.w * {q} + {alpha}) END,
        CASE WHEN v.{column} IS NULL THEN y.w * {q} ELSE 1.0 END
      FROM {name} y JOIN {source} v ON v.ticker = y.ticker AND v.i = y.i + 1)"""


CLOSES = f"{GRID_SQL}, v AS MATERIALIZED (SELECT ticker, i, bar_ts, close FROM g)"
FAST, SLOW, SIGN, WILDER = "(2.0::DOUBLE / 13)", "(2.0::DOUBLE / 27)", "0.2::DOUBLE", "(1.0::DOUBLE / 14)"


@query(
    "ewm_recursive_gaps",
    f"""WITH RECURSIVE {CLOSES}, {over_gaps("f", "v", "close", FAST)}, {over_gaps("s", "v", "close", WILDER)}
    SELECT ticker, bar_ts, {r("f.y", "e12")}, {r("s.y", "a14")}
    FROM v JOIN f USING (ticker, i) JOIN s USING (ticker, i)""",
)
def _(spark, sf):
    c = F.col("close")
    terms = {"e12": (c, S.alpha_of(span=12)), "a14": (c, S.alpha_of(alpha=1 / 14))}
    return rounded(S.ewm_gaps(grid_line(spark, sf), terms).map(lambda d: d.drop(*VALUES)).result())


@query(
    "macd_gaps",
    f"""WITH RECURSIVE {CLOSES}, {over_gaps("f", "v", "close", FAST)}, {over_gaps("s", "v", "close", SLOW)},
    m AS MATERIALIZED (SELECT ticker, i, f.y - s.y AS line FROM f JOIN s USING (ticker, i)), {over_gaps("z", "m", "line", SIGN)}
    SELECT ticker, bar_ts, {r("line", "macd_line")}, {r("z.y", "macd_signal")}, {r("line - z.y", "macd_hist")}
    FROM v JOIN m USING (ticker, i) JOIN z USING (ticker, i)""",
)
def _(spark, sf):
    return rounded(I.macd_gaps(grid_line(spark, sf)).map(lambda d: d.drop(*VALUES)).result())


@query(
    "rsi_gaps",
    f"""WITH RECURSIVE {CLOSES},
    d AS MATERIALIZED (SELECT ticker, i, m, CASE WHEN m IS NOT NULL THEN greatest(m, 0) END AS up,
                              CASE WHEN m IS NOT NULL THEN greatest(-m, 0) END AS down
                       FROM (SELECT ticker, i, close - lag(close) {OVER} AS m FROM v)),
    {over_gaps("u", "d", "up", WILDER)}, {over_gaps("w", "d", "down", WILDER)}
    SELECT ticker, bar_ts, {r("CASE WHEN w.y <> 0 THEN 100 - 100 / (1 + u.y / w.y) WHEN u.y > 0 THEN 100.0 END", "rsi")}
    FROM v JOIN u USING (ticker, i) JOIN w USING (ticker, i)""",
)
def _(spark, sf):
    return rounded(I.rsi_gaps(grid_line(spark, sf)).map(lambda d: d.drop(*VALUES)).result())


@query(
    "ewm_adjusted",
    f"""WITH RECURSIVE {NUMBERED}, {recursive("e", "close AS n, 1::DOUBLE AS m", "y.n * 11 / 13 + b.close, y.m * 11 / 13 + 1")}
    SELECT ticker, bar_ts, {r("n / m", "e12")} FROM b JOIN e USING (ticker, i)""",
)
def _(spark, sf):
    terms = {"e12": (F.col("close"), S.alpha_of(span=12))}
    return rounded(S.ewm(bar_line(spark, sf), terms, adjust=True).map(lambda d: d.drop(*VALUES)).result())


@query(
    "linear_recurrence",
    f"""WITH RECURSIVE {NUMBERED}, {recursive("e", "close AS y", "y.y * 2 / 3 + b.close")}
    SELECT ticker, bar_ts, {r("y", "y")} FROM b JOIN e USING (ticker, i)""",
)
def _(spark, sf):
    line = S.linear_recurrence(bar_line(spark, sf), {"y": (F.col("close"), 2 / 3)})
    return rounded(line.map(lambda d: d.drop(*VALUES)).result())


@query("linear_recurrence_blocks", ORACLES["linear_recurrence"])
def _(spark, sf):
    line = S.linear_recurrence(split_line(spark, sf), {"y": (F.col("close"), 2 / 3)})
    return rounded(line.map(lambda d: d.drop(*VALUES)).result())


@query(
    "sequence_windows",
    f"""WITH {BARS}, n AS (
      SELECT ticker, bar_ts, close, volume,
        lag(CAST(close > open AS INTEGER)) {OVER} AS sequence_label,
        row_number() {OVER} - 1 AS i,
        lag(close, 60) {OVER} AS first_close, lag(volume) {OVER} AS last_volume,
        sum(close) {OVER[:-1]} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS close_sum
      FROM bars)
    SELECT ticker, bar_ts, sequence_label, 60 AS steps, 2 AS width, first_close, last_volume, {r("close_sum", digits=4)}
    FROM n WHERE i >= 60""",
)
def _(spark, sf):
    line = bar_line(spark, sf).map(lambda d: d.withColumn("label", (F.col("close") > F.col("open")).cast("int")))
    seq = S.sequence_windows(line, ["close", "volume"], "label").result()
    s = F.col("sequence")
    return rounded(
        seq.select(
            "ticker",
            "bar_ts",
            "sequence_label",
            F.size(s).alias("steps"),
            F.size(s[0]).alias("width"),
            s[0][0].alias("first_close"),
            s[59][1].alias("last_volume"),
            F.aggregate(s, F.lit(0.0), lambda a, x: a + x[0]).alias("close_sum"),
        ),
        4,
        ["close_sum"],
    )


@query(
    "split_by_time",
    f"""WITH {NUMBERED}
    SELECT ticker, bar_ts, CASE WHEN i < floor(0.8 * count(*) OVER (PARTITION BY ticker)) THEN 'train' ELSE 'test' END AS part FROM b""",
)
def _(spark, sf):
    return S.split_by_time(bar_line(spark, sf)).map(lambda d: d.drop(*VALUES)).result()


@query(
    "split_random",
    "SELECT event_id, value, CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM events",
)
def _(spark, sf):
    return S.split_by_hash(table(spark, sf, "events").select("event_id", "value"), F.col("event_id"))


@query(
    "split_random_seeded",
    f"""WITH {BARS} SELECT *, CASE WHEN ('0x' || substr(md5('42|' || ticker || '|' || CAST(bar_ts AS VARCHAR)), 1, 8))::BIGINT % 10000 < 2000
        THEN 'test' ELSE 'train' END AS part FROM bars""",
)
def _(spark, sf):
    train, test = S.split_random(bars(spark, sf), ["ticker", "bar_ts"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "split_random_exact",
    """WITH h AS (SELECT event_id, event_type, md5('42|=' || event_id) AS place FROM events)
    SELECT event_id, event_type, CASE WHEN row_number() OVER (ORDER BY place) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS part
    FROM h""",
)
def _(spark, sf):
    """A fifth of the rows, exactly, by the smallest hashes of their keys."""
    train, test = S.split_exact(table(spark, sf, "events").select("event_id", "event_type"), ["event_id"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "target_next",
    f"""WITH {BARS}
    SELECT ticker, bar_ts, CAST(coalesce(lead(close) {OVER} > close, false) AS INTEGER) AS next1,
           CAST(coalesce(lead(close, 5) {OVER} > close, false) AS INTEGER) AS next5,
           CAST(lead(close, 5) {OVER} > close AS INTEGER) AS known5
    FROM bars""",
)
def _(spark, sf):
    line = S.target_next(bar_line(spark, sf), k=1, out="next1")
    line = S.target_next(line, k=5, out="next5")
    line = S.target_next(line, k=5, out="known5", drop_unlabelled=True)
    return line.map(lambda d: d.drop(*VALUES)).result()


