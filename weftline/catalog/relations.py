"""Merges, joins on labels, concatenation, alignment and aligned arithmetic."""

from pyspark.sql import functions as F

from weftline.catalog.registry import BARS, bars, query, r, rounded, table
from weftline.operators import joins, labelled

SIDES = """
l AS (SELECT nullif(o_custkey + 40, 55) AS key, o_orderkey, o_totalprice AS amount FROM orders),
r AS (SELECT nullif(c_custkey, 7) AS key, c_name, c_acctbal AS amount FROM customer)"""


def sides(spark, sf):
    """Keys are moved against each other, so that both sides have rows without partner and null keys."""
    left = F.nullif(F.col("o_custkey") + 40, F.lit(55)).alias("key")
    right = F.nullif(F.col("c_custkey"), F.lit(7)).alias("key")
    return (
        table(spark, sf, "orders").select(left, "o_orderkey", F.col("o_totalprice").alias("amount")),
        table(spark, sf, "customer").select(right, "c_name", F.col("c_acctbal").alias("amount")),
    )


def register_merge(how, sql_how):
    key = {"LEFT": "l.key", "RIGHT": "r.key", "INNER": "l.key", "FULL": "coalesce(l.key, r.key)"}[sql_how]

    @query(
        f"merge_{how}",
        f"""WITH {SIDES}
        SELECT {key} AS key, o_orderkey, l.amount AS amount_x, c_name, r.amount AS amount_y
        FROM l {sql_how} JOIN r ON l.key IS NOT DISTINCT FROM r.key""",
    )
    def _(spark, sf):
        return joins.merge(*sides(spark, sf), on="key", how=how)


for _how, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL"), ("inner", "INNER")):
    register_merge(_how, _sql)


@query(
    "join_index",
    """SELECT c_nationkey AS n_nationkey, c_custkey, n_name, n_regionkey
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return joins.join_index(c, table(spark, sf, "nation"), "n_nationkey")


@query(
    "concat_rows",
    """SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance", "c_mktsegment AS segment")
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS balance")
    return joins.concat_rows([c, s], keys=["customer", "supplier"])


COLS = """
a AS (SELECT c_custkey + 5 AS id, c_acctbal AS v FROM customer),
b AS (SELECT s_suppkey AS id, s_acctbal AS e FROM supplier),
c AS (SELECT o_custkey AS id, max(o_totalprice) AS v FROM orders GROUP BY 1)"""


def three(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey + 5 AS id", "c_acctbal AS v")
    b = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS e")
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("v"))
    return [a, b, c]


@query("concat_cols", f"WITH {COLS} SELECT id, a.v AS v, e, c.v AS v_2 FROM a FULL JOIN b USING (id) FULL JOIN c USING (id)")
def _(spark, sf):
    return joins.concat_cols(three(spark, sf), "id", repeats="refuse")


@query("concat_cols_inner", f"WITH {COLS} SELECT id, a.v AS v, e, c.v AS v_2 FROM a JOIN b USING (id) JOIN c USING (id)")
def _(spark, sf):
    return joins.concat_cols(three(spark, sf), "id", join="inner", repeats="refuse")


PAIR = """
p AS (SELECT p_partkey AS id, p_size AS a, p_retailprice AS b FROM part),
s AS (SELECT s_suppkey AS id, s_acctbal AS b, s_nationkey AS c FROM supplier)"""


def pair(spark, sf):
    return (
        table(spark, sf, "part").selectExpr("p_partkey AS id", "p_size AS a", "p_retailprice AS b"),
        table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS b", "s_nationkey AS c"),
    )


@query(
    "align",
    f"""WITH {PAIR}
    SELECT 'left' AS side, id, a, p.b AS b, CAST(NULL AS INTEGER) AS c FROM p FULL JOIN s USING (id)
    UNION ALL SELECT 'right', id, NULL, s.b, c FROM p FULL JOIN s USING (id)""",
)
def _(spark, sf):
    return labelled.align_long(*pair(spark, sf), "id")


@query(
    "align_inner",
    f"""WITH {PAIR}
    SELECT 'left' AS side, id, p.b AS b FROM p JOIN s USING (id)
    UNION ALL SELECT 'right', id, s.b FROM p JOIN s USING (id)""",
)
def _(spark, sf):
    return labelled.align_long(*pair(spark, sf), "id", join="inner")


@query(
    "arith_frames",
    f"""WITH {PAIR}
    SELECT id, CAST(NULL AS DOUBLE) AS a, {r("p.b - 2 * s.b", "b")}, CAST(NULL AS DOUBLE) AS c FROM p FULL JOIN s USING (id)""",
)
def _(spark, sf):
    left, right = pair(spark, sf)
    out = labelled.binary(left, labelled.binary(right, 2, "mul", "id"), "sub", "id")
    return rounded(out.select("id", *[F.col(c).cast("double").alias(c) for c in ("a", "b", "c")]))


@query(
    "arith_row_series",
    f"""SELECT p_partkey, CAST(NULL AS DOUBLE) AS other,
           {r("p_size - (SELECT avg(p_size) FROM part)", "p_size")},
           {r("p_retailprice - (SELECT avg(p_retailprice) FROM part)", "p_retailprice")},
           CAST(NULL AS DOUBLE) AS weight
    FROM (SELECT *, 1.0::DOUBLE AS weight FROM part)""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(1.0).alias("weight"))
    row = {"p_size": F.avg("p_size"), "p_retailprice": F.avg("p_retailprice"), "other": 5}
    return rounded(labelled.arith_row_series(p, row, "sub", "p_partkey"))


@query(
    "arith_col_series",
    f"""WITH o AS (SELECT o_custkey AS id, sum(o_totalprice) AS value FROM orders GROUP BY 1)
    SELECT id, {r("c_acctbal + value", "c_acctbal", 3)}, {r("c_nationkey + value", "c_nationkey", 3)}
    FROM (SELECT c_custkey + 10 AS id, c_acctbal, c_nationkey FROM customer) FULL JOIN o USING (id)""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey + 10 AS id", "c_acctbal", "c_nationkey")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("value"))
    return rounded(labelled.arith_col_series(c, o, "add", "id"), 3)


@query(
    "arith_own_column",
    f"SELECT p_partkey, {r('p_size * p_retailprice', 'p_size')}, {r('p_retailprice * p_retailprice', 'p_retailprice')} FROM part",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(labelled.arith_own_column(p, "p_retailprice", "mul", "p_partkey"))


NATIONS = """
s AS (SELECT s_nationkey AS n, sum(s_acctbal) AS v, count(*) AS k FROM supplier GROUP BY 1),
c AS (SELECT c_nationkey + 3 AS n, sum(c_acctbal) AS v, count(*) AS k FROM customer GROUP BY 1)"""


@query(
    "arith_flex",
    f"""WITH {NATIONS}
    SELECT n, {r("(coalesce(c.v, 1) / coalesce(s.v, 1))", "v_rdiv")}, {r("coalesce(c.k, 1) / coalesce(s.k, 1)", "k_rdiv")},
           {r("s.v + c.v", "v_add", 3)}, {r("c.v - s.v", "v_rsub", 3)}
    FROM s FULL JOIN c USING (n)""",
)
def _(spark, sf):
    def per(name, key, bal):
        t = table(spark, sf, name).groupBy(key.alias("n"))
        return t.agg(F.sum(bal).alias("v"), F.count(F.lit(1)).alias("k"))

    s = per("supplier", F.col("s_nationkey"), "s_acctbal")
    c = per("customer", F.col("c_nationkey") + 3, "c_acctbal")
    wanted = [("v", "rdiv", 1), ("k", "rdiv", 1), ("v", "add", None), ("v", "rsub", None)]
    out = labelled.binary_many(s, c, wanted, "n")
    return rounded(rounded(out, 6, ["k_rdiv", "v_rdiv"]), 3, ["v_add", "v_rsub"])


# every ticker against itself an hour earlier, so that labels of either side lack a partner
HALVES = """
l AS (SELECT ticker, bar_ts, open, close FROM bars),
r AS (SELECT ticker, bar_ts + INTERVAL 1 HOUR AS bar_ts, close, high FROM bars)"""
LABEL = ["ticker", "bar_ts"]


def halves(spark, sf):
    b = bars(spark, sf)
    later = (F.col("bar_ts") + F.expr("INTERVAL 1 HOUR")).alias("bar_ts")
    return b.select(*LABEL, "open", "close"), b.select("ticker", later, "close", "high")


@query(
    "compare_flex",
    f"""WITH {BARS}, {HALVES}
    SELECT ticker, bar_ts, coalesce(l.close < r.close, false) AS close, false AS high, false AS open
    FROM l FULL JOIN r USING (ticker, bar_ts)""",
)
def _(spark, sf):
    return labelled.compare(*halves(spark, sf), "lt", LABEL)


@query("compare_same", f"WITH {BARS} SELECT ticker, bar_ts, open <> close AS price FROM bars")
def _(spark, sf):
    b = bars(spark, sf)
    first, last = (b.select(*LABEL, F.col(c).alias("price")) for c in ("open", "close"))
    return labelled.compare_same(first, last, "ne", LABEL)


@query(
    "compare_series",
    f"""WITH {BARS}, {HALVES}
    SELECT ticker, bar_ts, coalesce(l.open < r.close, false) AS open, coalesce(l.close < r.close, false) AS close
    FROM l FULL JOIN r USING (ticker, bar_ts)""",
)
def _(spark, sf):
    left, right = halves(spark, sf)
    return labelled.compare_col_series(left, right, "lt", LABEL, "close")


@query(
    "mask_compare",
    f"""WITH {BARS}, {HALVES}
    SELECT ticker, bar_ts, CASE WHEN l.close > r.close THEN l.close END AS close, CAST(NULL AS DOUBLE) AS open
    FROM l FULL JOIN r USING (ticker, bar_ts)""",
)
def _(spark, sf):
    return labelled.mask_compare(*halves(spark, sf), "gt", LABEL)


PER_NATION = "(SELECT c_nationkey AS n, sum(c_acctbal) AS total, count(*) AS k FROM customer GROUP BY 1)"


def per_nation(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(
        F.sum("c_acctbal").alias("total"), F.count(F.lit(1)).alias("k")
    )


@query(
    "reindex_rows",
    f"""SELECT n, CAST(label_order AS INTEGER) AS label_order,
           round(CASE WHEN p.k IS NULL THEN 0 ELSE total END, 3) + 0.0 AS total, coalesce(k, 0) AS k
    FROM (VALUES (0, 9), (1, 3), (2, 99), (3, 0)) v(label_order, n) LEFT JOIN {PER_NATION} p USING (n)""",
)
def _(spark, sf):
    return rounded(labelled.reindex_rows(per_nation(spark, sf), "n", [9, 3, 99, 0], fill=0), 3)


@query("reindex_cols", "SELECT c_custkey, CAST(NULL AS DOUBLE) AS c_debt, c_acctbal, c_name FROM customer")
def _(spark, sf):
    return labelled.reindex_cols(table(spark, sf, "customer"), ["c_custkey", "c_debt", "c_acctbal", "c_name"])


@query(
    "reindex_like",
    """SELECT c_custkey AS id, s_acctbal AS balance, CAST(NULL AS DOUBLE) AS segment
       FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS balance", "s_nationkey AS nation")
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance", "c_mktsegment AS segment")
    return labelled.reindex_like(s, "id", c)


