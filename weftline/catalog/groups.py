"""Group operators and ordered categories."""

from pyspark.sql import functions as F

from weftline.catalog.registry import query, r, rounded, rs, table
from weftline.operators import groups

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "group_agg",
    f"""SELECT l_returnflag, l_linestatus, max(l_quantity) AS top_quantity, {r("sum(l_extendedprice)", "price", 2)}
    FROM lineitem GROUP BY 1, 2""",
)
def _(spark, sf):
    out = groups.group_agg(
        table(spark, sf, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {"top_quantity": F.max("l_quantity"), "price": F.sum("l_extendedprice")},
    )
    return rounded(out, 2, ["price"])


@query(
    "group_transform",
    f"""SELECT l_orderkey, l_linenumber, {r("sum(l_quantity) OVER w", "quantity", 2)}, {r("sum(l_tax) OVER w", "tax", 2)}
    FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""",
)
def _(spark, sf):
    out = groups.group_transform(
        table(spark, sf, "lineitem"),
        ["l_suppkey"],
        ["l_orderkey", "l_linenumber"],
        {"quantity": F.sum("l_quantity"), "tax": F.sum("l_tax")},
    )
    return rounded(out, 2)


@query(
    "group_apply",
    f"""SELECT l_suppkey, CAST(sum(l_suppkey) AS BIGINT) AS l_suppkey_sum,
           {rs({"l_quantity": "sum(l_quantity)", "l_tax": "sum(l_tax)"}, 2)} FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    return rounded(
        groups.group_sum_with_key(table(spark, sf, "lineitem"), "l_suppkey", ["l_quantity", "l_tax"]), 2
    )


@query(
    "group_level",
    """SELECT 0 AS level, o_orderstatus AS label, max(top) AS top FROM
         (SELECT o_orderstatus, o_orderpriority, max(o_totalprice) AS top FROM orders GROUP BY 1, 2) GROUP BY 2
       UNION ALL SELECT 1, o_orderpriority, max(o_totalprice) FROM orders GROUP BY 2""",
)
def _(spark, sf):
    two = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.max("o_totalprice").alias("top"))
    first = groups.group_level(two, "o_orderstatus", ["top"]).toDF("label", "top")
    second = groups.group_level(two, "o_orderpriority", ["top"]).toDF("label", "top")
    return first.select(F.lit(0).alias("level"), "*").unionByName(second.select(F.lit(1).alias("level"), "*"))


CELLS = {
    "X_A": "max(l_quantity)",
    "X_B": "max(l_linenumber * 9.0)",
    "Y_A": "min(l_quantity)",
    "Y_B": "min(l_linenumber * 2.0)",
}


@query(
    "group_level_cols",
    f"""WITH w AS (SELECT l_suppkey, {", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in CELLS.items())} FROM lineitem GROUP BY 1)
    SELECT l_suppkey, greatest(X_A, X_B) AS "X", greatest(Y_A, Y_B) AS "Y",
           greatest(X_A, Y_A) AS "A", greatest(X_B, Y_B) AS "B" FROM w""",
)
def _(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        *[F.expr(e).cast("double").alias(n) for n, e in CELLS.items()]
    )
    high = groups.group_level_cols(wide, ["l_suppkey"], 0)
    return high.join(groups.group_level_cols(wide, ["l_suppkey"], 1), "l_suppkey")


@query(
    "category_sort",
    """SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS o_orderpriority,
         CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2
                                   WHEN '4-NOT SPECIFIED' THEN 3 END AS BIGINT) AS o_orderpriority_code FROM orders""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return groups.category_sort(
        o, "o_orderpriority", ["5-LOW", "1-URGENT", "2-HIGH", "4-NOT SPECIFIED"], ["o_orderkey"]
    )


@query(
    "category_size",
    """SELECT c AS o_orderpriority, count(o_orderkey) AS size
       FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE')) v(c)
       LEFT JOIN orders ON o_orderpriority = c GROUP BY 1""",
)
def _(spark, sf):
    return groups.category_size(table(spark, sf, "orders"), "o_orderpriority", [*PRIORITIES, "6-NONE"])
