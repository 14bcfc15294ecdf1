"""Whole-table statistics."""

from pyspark.sql import functions as F

from weftline.catalog.registry import BARS, GRID, bar_line, bars, grid, query, r, rounded, rs, table
from weftline.operators import series as S
from weftline.operators import stats

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
VALUES = ["open", "high", "low", "close", "volume"]


@query(
    "agg_global_sql",
    f"""WITH {BARS}
    SELECT min(bar_ts) AS start_date, max(bar_ts) AS end_date, count(*) AS row_count, {r("avg(close)", "avg_close")} FROM bars""",
)
def _(spark, sf):
    text = "SELECT min(bar_ts) AS start_date, max(bar_ts) AS end_date, count(*) AS row_count, avg(close) AS avg_close FROM summed_bars"
    return rounded(stats.summary_sql(bars(spark, sf), "summed_bars", text))


@query(
    "date_range",
    f"""WITH {BARS} SELECT ticker, CAST(min(bar_ts) AS DATE) AS first_date, CAST(max(bar_ts) AS DATE) AS last_date
    FROM bars GROUP BY 1""",
)
def _(spark, sf):
    return stats.date_range(bars(spark, sf), "bar_ts", ["bar_ts"], ["ticker"])


@query(
    "agg_multi",
    "SELECT 'mean' AS stat, "
    + rs({c: f"avg({c})" for c in NUMBERS}, 4)
    + " FROM lineitem UNION ALL SELECT 'sum', "
    + rs({c: f"sum({c})" for c in NUMBERS}, 4)
    + " FROM lineitem",
)
def _(spark, sf):
    return rounded(stats.agg_list(table(spark, sf, "lineitem"), NUMBERS, ["mean", "sum"]), 4)


@query("agg_map", f"SELECT {r('avg(l_quantity)', 'l_quantity')}, {r('sum(l_tax)', 'l_tax', 4)} FROM lineitem")
def _(spark, sf):
    out = stats.agg_map(table(spark, sf, "lineitem"), {"l_quantity": "mean", "l_tax": "sum"})
    return rounded(rounded(out, 6, ["l_quantity"]), 4, ["l_tax"])


@query(
    "apply_cols",
    f"""SELECT CAST(max(p_size) - min(p_size) AS INTEGER) AS p_size, {r("max(p_retailprice) - min(p_retailprice)", "p_retailprice")} FROM part""",
)
def _(spark, sf):
    return rounded(stats.apply_cols(table(spark, sf, "part"), ["p_size", "p_retailprice"], stats.STATS["range"]))


@query("apply_all", "SELECT greatest(max(p_size), max(p_retailprice)) AS value FROM part")
def _(spark, sf):
    return stats.apply_all(table(spark, sf, "part"), ["p_size", "p_retailprice"])


@query(
    "apply_rows",
    f"""WITH {GRID}
    SELECT ticker, bar_ts, {r("coalesce(high, 0) + coalesce(low, 0)", "total")}, {r("(high + low) / 2", "mean")},
           {r("high - low", "span")}, {r("open + close", "added")} FROM grid""",
)
def _(spark, sf):
    two = ["high", "low"]
    return rounded(
        grid(spark, sf).select(
            "ticker",
            "bar_ts",
            stats.row_sum(two).alias("total"),
            stats.row_mean(two).alias("mean"),
            stats.row_range(two).alias("span"),
            (F.col("open") + F.col("close")).alias("added"),
        )
    )


@query(
    "mean_axis",
    f"WITH {GRID} SELECT true AS skipna, {rs({c: f'avg({c})' for c in VALUES})} FROM grid UNION ALL SELECT false, "
    + rs({c: f"CASE WHEN count({c}) = count(*) THEN avg({c}) END" for c in VALUES})
    + " FROM grid",
)
def _(spark, sf):
    g = grid(spark, sf)
    skipped = stats.mean_axis(g, VALUES).select(F.lit(True).alias("skipna"), "*")
    return rounded(skipped.unionByName(stats.mean_axis(g, VALUES, skipna=False).select(F.lit(False).alias("skipna"), "*")))


def described(columns, source):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f"avg({c})", "mean", 4)}, {r(f"stddev_samp({c})", "std", 4)},
        {r(f"min({c})", "min", 4)}, {r(f"max({c})", "max", 4)}, {r(f"quantile_cont({c}, 0.25)", "q25", 4)},
        {r(f"quantile_cont({c}, 0.5)", "q50", 4)}, {r(f"quantile_cont({c}, 0.75)", "q75", 4)} FROM {source}"""
        for c in columns
    )


@query("describe_numeric", described(NUMBERS, "lineitem"))
def _(spark, sf):
    return rounded(stats.describe_numeric(table(spark, sf, "lineitem"), NUMBERS), 4)


@query("describe_bars", f"WITH {BARS} {described(VALUES, 'bars')}")
def _(spark, sf):
    return rounded(stats.describe_numeric(bars(spark, sf), VALUES), 4)


@query(
    "describe_object",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(DISTINCT {c}) AS "unique",
        (SELECT {c} FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
        (SELECT count(*) FROM part GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS freq FROM part"""
        for c in ("p_name", "p_brand", "p_type")
    ),
)
def _(spark, sf):
    return stats.describe_object(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@query(
    "standardize",
    f"""SELECT p_partkey,
       {r("(p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER ()", "p_size")},
       {r("(p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER ()", "p_retailprice")} FROM part""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(stats.standardize(p, ["p_size", "p_retailprice"]))


@query(
    "standardize_fit",
    f"""WITH f AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2
              FROM part WHERE p_type = 'ECONOMY')
    SELECT p_partkey, {r("(p_size - m) / s", "p_size")}, {r("(p_retailprice - m2) / s2", "p_retailprice")} FROM part, f""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    fitted = p.filter("p_type = 'ECONOMY'")
    return rounded(stats.standardize(p.drop("p_type"), ["p_size", "p_retailprice"], ddof=0, fit_on=fitted))


@query(
    "value_counts",
    f"""WITH {BARS}, t AS (
      SELECT CAST(coalesce(lead(close) OVER (PARTITION BY ticker ORDER BY bar_ts) > close, false) AS INTEGER) AS target FROM bars)
    SELECT target, count(*) AS count FROM t GROUP BY 1""",
)
def _(spark, sf):
    return stats.value_counts(S.target_next(bar_line(spark, sf)).result(), "target")


@query(
    "share_of_total",
    f"""SELECT o_orderstatus, {r("sum(o_totalprice)", "amount", 2)},
           {r("100.0 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders)", "percent")} FROM orders GROUP BY 1""",
)
def _(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("amount"))
    out = stats.share_of_total(per, "amount")
    return rounded(rounded(out, 2, ["amount"]), 6, ["percent"])


@query(
    "box_stats",
    f"""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                          quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
      v AS (SELECT l.l_returnflag, q1, median, q3, l_extendedprice AS x,
                   l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
            FROM lineitem l JOIN q USING (l_returnflag))
    SELECT l_returnflag, {rs(["q1", "median", "q3"])}, min(x) FILTER (inside) AS whisker_low,
           max(x) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS fliers
    FROM v GROUP BY ALL""",
)
def _(spark, sf):
    out = stats.box_stats(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return rounded(out, 6, ["q1", "median", "q3"])


@query(
    "null_counts",
    f"WITH {GRID} SELECT "
    + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in VALUES)
    + ", "
    + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in VALUES)
    + " AS total FROM grid",
)
def _(spark, sf):
    return stats.null_counts(grid(spark, sf), VALUES)


@query(
    "density",
    f"WITH {GRID} SELECT {rs({c: f'count({c}) / count(*)' for c in VALUES})}, "
    + r("(" + " + ".join(f"count({c})" for c in VALUES) + ") / (5.0 * count(*))", "all_cells")
    + " FROM grid",
)
def _(spark, sf):
    return rounded(stats.density(grid(spark, sf), VALUES))


@query(
    "known_cells",
    f"""WITH {GRID}
    SELECT ticker, bar_ts, 'close' AS "column", {r("close", "value")} FROM grid WHERE close IS NOT NULL
    UNION ALL SELECT ticker, bar_ts, 'volume', round(volume, 6) + 0.0 FROM grid WHERE volume IS NOT NULL""",
)
def _(spark, sf):
    return rounded(stats.known_cells(grid(spark, sf), ["ticker", "bar_ts"], ["close", "volume"]))
