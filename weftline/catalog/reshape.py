"""Long and wide forms, missing data."""

from pyspark.sql import functions as F

from weftline.catalog.registry import (
    BARS,
    GRID,
    OVER,
    bar_line,
    grid,
    grid_line,
    query,
    r,
    rounded,
    table,
)
from weftline.operators import clean, reshape
from weftline.operators import series as S

VALUES = ["open", "high", "low", "close", "volume"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STATUSES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "transpose",
    "WITH s AS (SELECT c_mktsegment AS k, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", """
        + ", ".join(f"CAST(max({c}) FILTER (k = '{s}') AS VARCHAR) AS \"{s}\"" for s in SEGMENTS)
        + " FROM s"
        for c in ("n", "nations")
    ),
)
def _(spark, sf):
    per = table(spark, sf, "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("nations")
    )
    return reshape.transpose(per, "c_mktsegment", ["n", "nations"])


PER_NATION = """n AS (SELECT c_nationkey, max(c_acctbal) FILTER (c_acctbal > 9900) AS rich, count(*)::DOUBLE AS k,
                        min(c_acctbal) AS least FROM customer GROUP BY 1)"""


def per_nation(spark, sf):
    bal = F.col("c_acctbal")
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.max(F.when(bal > 9900, bal)).alias("rich"),
        F.count(F.lit(1)).cast("double").alias("k"),
        F.min(bal).alias("least"),
    )


@query(
    "stack",
    f"WITH {PER_NATION} "
    + " UNION ALL ".join(
        f"""SELECT c_nationkey, '{c}' AS "column", {c} AS value FROM n WHERE {c} IS NOT NULL""" for c in ("rich", "k", "least")
    ),
)
def _(spark, sf):
    return reshape.stack(per_nation(spark, sf), ["c_nationkey"], ["rich", "k", "least"])


LEVELS = {
    "X_a": "max(l_quantity)",
    "X_b": "min(l_quantity)",
    "Y_a": "max(l_discount)",
    "Y_b": "min(l_discount)",
}


@query(
    "stack_level",
    f"WITH w AS (SELECT l_suppkey, {', '.join(f'{e} AS {n}' for n, e in LEVELS.items())} FROM lineitem GROUP BY 1) "
    + " UNION ALL ".join(f"""SELECT l_suppkey, '{v}' AS level, X_{v} AS "X", Y_{v} AS "Y" FROM w""" for v in "ab"),
)
def _(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(*[F.expr(e).alias(n) for n, e in LEVELS.items()])
    return reshape.stack_level(wide, ["l_suppkey"])


@query(
    "unstack",
    "WITH s AS (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS top FROM orders GROUP BY 1, 2) SELECT o_custkey, "
    + ", ".join(f"max(top) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in STATUSES)
    + " FROM s GROUP BY 1",
)
def _(spark, sf):
    long = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("top"))
    return reshape.unstack(long, ["o_custkey"], "o_orderstatus", "top")


@query(
    "melt",
    """SELECT p_partkey, 'p_size' AS measure, CAST(p_size AS DOUBLE) AS amount FROM part
       UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""",
)
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return reshape.melt(p, ["p_partkey"], ["p_size", "p_retailprice"], "measure", "amount")


def spread(agg, column, name, labels=PRIORITIES, digits=2):
    return ", ".join(
        f"round({agg}({column}) FILTER (o_orderpriority = '{x}'), {digits}) + 0.0 AS \"{name}_{x}\"" for x in labels
    )


@query(
    "pivot_table",
    f"""SELECT o_orderstatus, {spread("sum", "o_totalprice", "o_totalprice")}, {spread("sum", "k", "k")}
    FROM (SELECT *, CAST(o_custkey AS DOUBLE) AS k FROM orders) GROUP BY 1""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("k", F.col("o_custkey").cast("double"))
    out = reshape.pivot_table(o, ["o_orderstatus"], "o_orderpriority", {"o_totalprice": "sum", "k": "sum"})
    return rounded(out, 2)


@query(
    "pivot_table_multi",
    f"""SELECT o_orderstatus, {spread("sum", "k", "k")}, {spread("min", "o_totalprice", "o_totalprice_min")},
        {spread("max", "o_totalprice", "o_totalprice_max")}, {spread("avg", "o_totalprice", "o_totalprice_mean")}
    FROM (SELECT *, CAST(o_custkey AS DOUBLE) AS k FROM orders) GROUP BY 1""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("k", F.col("o_custkey").cast("double"))
    aggs = {"k": "sum", "o_totalprice": ["min", "max", "mean"]}
    return rounded(reshape.pivot_table(o, ["o_orderstatus"], "o_orderpriority", aggs), 2)


# -- missing data --------------------------------------------------------------


@query(
    "isnull_notnull",
    f"WITH {GRID} SELECT ticker, bar_ts, close IS NULL AS close, volume IS NOT NULL AS volume FROM grid",
)
def _(spark, sf):
    g = grid(spark, sf).select("ticker", "bar_ts", "close", "volume")
    return clean.notnull(clean.isnull(g, ["close"]), ["volume"])


@query(
    "dropna",
    f"""WITH {GRID}, m AS (SELECT ticker, bar_ts, close, CASE WHEN volume > 50 THEN volume END AS volume FROM grid)
    SELECT 'any' AS how, ticker, bar_ts, close, volume FROM m WHERE close IS NOT NULL AND volume IS NOT NULL
    UNION ALL SELECT 'all', ticker, bar_ts, close, volume FROM m WHERE close IS NOT NULL OR volume IS NOT NULL
    UNION ALL SELECT 'thresh', ticker, bar_ts, close, volume FROM m WHERE close IS NOT NULL""",
)
def _(spark, sf):
    m = grid(spark, sf).select(
        "ticker", "bar_ts", "close", F.when(F.col("volume") > 50, F.col("volume")).alias("volume")
    )
    parts = {
        "any": clean.dropna(m),
        "all": clean.dropna(m, how="all", subset=["close", "volume"]),
        "thresh": clean.dropna(m, thresh=3),
    }
    out = [d.select(F.lit(k).alias("how"), "*") for k, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("dropna_cols", f"WITH {GRID} SELECT ticker, bar_ts FROM grid")
def _(spark, sf):
    return clean.dropna_cols(grid(spark, sf), ["bar_ts", *VALUES], key=["ticker"])


@query(
    "fillna_value",
    f"""WITH {GRID}
    SELECT ticker, bar_ts, coalesce(open, 0.0) AS open, coalesce(high, 10.0) AS high,
           CASE WHEN volume IS NULL THEN 'Empty' ELSE CAST(CAST(volume AS BIGINT) AS VARCHAR) END AS volume FROM grid""",
)
def _(spark, sf):
    g = grid(spark, sf).select("ticker", "bar_ts", "open", "high", F.col("volume").cast("bigint").alias("volume"))
    return clean.fillna(clean.fillna(g, {"open": 0.0, "high": 10.0}), "Empty", ["volume"])


@query(
    "fillna_mean",
    f"""WITH {GRID}
    SELECT ticker, bar_ts, {r("coalesce(close, (SELECT avg(close) FROM grid))", "close")},
           {r("coalesce(volume, (SELECT avg(close) FROM grid))", "volume")},
           {r("coalesce(high, (SELECT avg(high) FROM grid))", "high")} FROM grid""",
)
def _(spark, sf):
    g = grid(spark, sf).select("ticker", "bar_ts", "close", "volume", "high")
    own = clean.fillna_mean(g, ["high"])
    return rounded(clean.fillna_mean(own, ["close", "volume"], source="close"))


@query(
    "ffill",
    f"""WITH {GRID}
    SELECT ticker, bar_ts, last_value(close IGNORE NULLS) {OVER[:-1]} ROWS UNBOUNDED PRECEDING) AS close FROM grid""",
)
def _(spark, sf):
    return S.ffill(grid_line(spark, sf), ["close"]).result().select("ticker", "bar_ts", "close")


@query(
    "bfill",
    f"""WITH {GRID}
    SELECT ticker, bar_ts,
      first_value(close IGNORE NULLS) {OVER[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM grid""",
)
def _(spark, sf):
    return S.bfill(grid_line(spark, sf), ["close"]).result().select("ticker", "bar_ts", "close")


@query(
    "interpolate",
    f"""WITH {GRID}, k AS (
      SELECT ticker, bar_ts, i, close,
        last_value(close IGNORE NULLS) {OVER[:-1]} ROWS UNBOUNDED PRECEDING) AS lo,
        last_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) {OVER[:-1]} ROWS UNBOUNDED PRECEDING) AS lo_i,
        first_value(close IGNORE NULLS) {OVER[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi,
        first_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS)
          {OVER[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi_i
      FROM g)
    SELECT ticker, bar_ts,
      {r("CASE WHEN close IS NOT NULL THEN close WHEN hi IS NULL THEN lo ELSE lo + (hi - lo) * (i - lo_i) / (hi_i - lo_i) END", "forward")},
      {r("CASE WHEN close IS NOT NULL THEN close ELSE lo + (hi - lo) * (i - lo_i) / (hi_i - lo_i) END", "inside")}
    FROM k""",
)
def _(spark, sf):
    line = grid_line(spark, sf).map(
        lambda d: d.withColumns({"forward": F.col("close"), "inside": F.col("close")}).drop(*VALUES)
    )
    line = S.interpolate(line, ["forward"], "forward")
    return rounded(S.interpolate(line, ["inside"], "inside").result())


@query(
    "replace_values",
    "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'BASIC' WHEN 'PROMO' THEN 'OFFER' ELSE p_type END AS p_type FROM part",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    return clean.replace_values(p, {"ECONOMY": "BASIC", "PROMO": "OFFER"}, ["p_type"])


@query(
    "shift",
    f"""WITH {BARS}
    SELECT ticker, bar_ts, lag(close) {OVER} AS before, lead(close, 2) {OVER} AS ahead, lag(close, 1, 0.0) {OVER} AS filled
    FROM bars""",
)
def _(spark, sf):
    def build(d, f):
        c = F.col("close")
        return d.select(
            *[x for x in d.columns if x not in VALUES],
            S.shift(c, 1, f).alias("before"),
            S.shift(c, -2, f).alias("ahead"),
            S.shift(c, 1, f, 0.0).alias("filled"),
        )

    return bar_line(spark, sf).roll(build, before=1, after=2).result()


@query(
    "shift_cols",
    "SELECT p_partkey AS id, CAST(NULL AS DOUBLE) AS p_partkey, CAST(p_partkey AS DOUBLE) AS p_size, CAST(p_size AS DOUBLE) AS p_retailprice FROM part",
)
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_partkey", "p_size", "p_retailprice")
    return clean.shift_cols(p, ["p_partkey", "p_size", "p_retailprice"], 1)


