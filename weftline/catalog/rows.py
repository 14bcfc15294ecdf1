"""Selection, schema, filters, sorting and duplicates."""

from pyspark.sql import functions as F

from weftline.catalog.registry import BARS, bars, query, rounded, rs, table
from weftline.operators import filters, labelled, ordering, select
from weftline.operators import series as S

VALUES = ["open", "high", "low", "close", "volume"]


@query("select_cols", "SELECT c_name, c_acctbal FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_name", "c_acctbal")


@query("select_col_slice", "SELECT l_quantity, l_extendedprice, l_discount FROM lineitem")
def _(spark, sf):
    wide = select.col_slice(table(spark, sf, "lineitem"), "l_quantity", "l_tax")
    return select.col_positions(wide, slice(0, 3))


@query("select_dtypes", "SELECT p_partkey, p_size FROM part")
def _(spark, sf):
    return select.select_dtypes(table(spark, sf, "part"), include=["bool", "int"])


@query("select_dtypes_exclude", "SELECT p_name, p_brand, p_type, p_retailprice FROM part")
def _(spark, sf):
    return select.select_dtypes(table(spark, sf, "part"), exclude=["bool", "int"])


@query(
    "label_rows",
    """SELECT CASE c_nationkey WHEN 7 THEN 0 ELSE 1 END AS label_order, c_nationkey, c_custkey, c_acctbal
       FROM customer WHERE c_nationkey IN (7, 3)""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return select.label_rows(c, "c_nationkey", [7, 3])


@query(
    "label_slice",
    "SELECT c_name, c_acctbal FROM customer WHERE c_name BETWEEN 'Customer#000000010' AND 'Customer#000000120'",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_name", "c_acctbal")
    return select.label_slice(c, "c_name", "Customer#000000010", "Customer#000000120")


@query(
    "label_slice_unsorted",
    """WITH p AS (SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer)
       SELECT c_custkey, c_name, c_acctbal FROM p
       WHERE i BETWEEN (SELECT min(i) FROM p WHERE c_name IN ('Customer#000000010', 'Customer#000000120'))
                   AND (SELECT max(i) FROM p WHERE c_name IN ('Customer#000000010', 'Customer#000000120'))
         AND (SELECT i FROM p WHERE c_name = 'Customer#000000010') <= (SELECT i FROM p WHERE c_name = 'Customer#000000120')
       UNION ALL
       SELECT c_custkey, c_name, c_acctbal FROM p
       WHERE i BETWEEN (SELECT min(i) FROM p WHERE c_name IN ('Customer#000000010', 'Customer#000000120'))
                   AND (SELECT max(i) FROM p WHERE c_name IN ('Customer#000000010', 'Customer#000000120'))
         AND (SELECT i FROM p WHERE c_name = 'Customer#000000010') > (SELECT i FROM p WHERE c_name = 'Customer#000000120')""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    order = ["c_acctbal", "c_custkey"]
    a, b = "Customer#000000010", "Customer#000000120"
    # one of the two directions is empty
    return select.label_slice(c, "c_name", a, b, order).unionByName(select.label_slice(c, "c_name", b, a, order))


@query(
    "pos_slice",
    """SELECT o_orderkey, o_totalprice FROM
       (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
       WHERE i >= n - 50 AND i < n - 10""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return select.pos_slice(o, ["o_orderkey"], -50, -10)


@query(
    "pos_slice_head",
    """SELECT o_orderkey, o_totalprice FROM
       (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders) WHERE i >= 20 AND i < 45""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return select.pos_slice(o, ["o_totalprice", "o_orderkey"], 20, 45)


@query(
    "pos_rows",
    """SELECT o_orderkey, o_totalprice FROM
       (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders) WHERE i IN (0, 7, 1000)""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return select.pos_rows(o, ["o_totalprice", "o_orderkey"], [0, 7, 1000])


@query(
    "head_tail",
    """(SELECT 'head' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5)
       UNION ALL (SELECT 'tail', o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5)""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    first = select.head(o, ["o_orderkey"], 5).select(F.lit("head").alias("side"), "*")
    return first.unionByName(select.tail(o, ["o_orderkey"], 5).select(F.lit("tail").alias("side"), "*"))


@query(
    "tail_per_key",
    f"""WITH {BARS}
    SELECT ticker, bar_ts, {rs(VALUES)} FROM
      (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) AS i, count(*) OVER (PARTITION BY ticker) AS n
       FROM bars)
    WHERE i <= 252 AND n >= 252""",
)
def _(spark, sf):
    kept, _short = S.warm_tail(bars(spark, sf), ["ticker"], ["bar_ts"], 252)
    return rounded(kept)


@query(
    "assign",
    """SELECT c_custkey, c_acctbal, c_nationkey, c_acctbal * 2 AS twice, 17 AS fixed, n_name AS nation
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    c = c.withColumns({"twice": F.col("c_acctbal") * 2, "fixed": F.lit(17)})
    names = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return select.assign_series(c, "c_nationkey", names, "nation", "n_name")


@query(
    "insert_pop_del",
    "SELECT p_partkey, p_size AS z, p_name, p_brand, p_brand AS brand2, p_retailprice FROM part",
)
def _(spark, sf):
    p = table(spark, sf, "part").drop("p_type")
    p, size = select.pop_col(p, ["p_partkey"], "p_size")
    p = select.assign_series(p, "p_partkey", size, "popped", "p_size")
    p = select.insert_col(p, 1, "z", F.col("popped")).drop("popped")
    return select.insert_col(p, 4, "brand2", F.col("p_brand"))


@query(
    "row_upsert",
    """SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer
       UNION ALL SELECT -1 - c_custkey, c_name, 1.0 FROM customer WHERE c_acctbal < 0""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    owing = c.filter(F.col("c_acctbal") < 0)
    rows = owing.withColumn("c_acctbal", F.lit(0.0)).unionByName(
        owing.withColumns({"c_custkey": -1 - F.col("c_custkey"), "c_acctbal": F.lit(1.0)})
    )
    return select.row_upsert(c, "c_custkey", rows)


@query(
    "row_patch",
    """SELECT c_custkey,
         CASE c_custkey WHEN 0 THEN (SELECT c_name FROM customer WHERE c_custkey = 2) ELSE c_name END AS c_name,
         CASE c_custkey WHEN 0 THEN (SELECT c_acctbal FROM customer WHERE c_custkey = 2)
                        WHEN 7 THEN 0.0 ELSE c_acctbal END AS c_acctbal
       FROM customer""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    c = select.row_patch(c, "c_custkey", 7, {"c_acctbal": 0.0})
    return select.row_copy(c, "c_custkey", 2, 0)


@query("drop_rows", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey NOT IN (0, 2)")
def _(spark, sf):
    return select.drop_rows(table(spark, sf, "customer"), "c_nationkey", [0, 2]).drop("c_name", "c_mktsegment")


@query("rename", 'SELECT p_partkey AS "P_PARTKEY", p_name AS "P_NAME", p_retailprice AS "PRICE" FROM part')
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return select.rename_all(p.withColumnsRenamed({"p_retailprice": "price"}), str.upper)


@query("map_labels", "SELECT substr(c_name, 1, 14) AS c_name, c_acctbal FROM customer")
def _(spark, sf):
    from weftline.functions.text import prefix

    return table(spark, sf, "customer").select(prefix(F.col("c_name"), 14).alias("c_name"), "c_acctbal")


@query("set_reset_index", "SELECT p_partkey AS id, p_size, p_retailprice FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_size", "p_partkey", "p_brand", "p_retailprice")
    lab = labelled.Labelled(p).set_index("p_partkey", "p_brand").droplevel(1)
    return lab.reset_index({"p_partkey": "id"}).frame()


@query(
    "flatten_columns",
    """SELECT l_suppkey, max(l_extendedprice) AS top, min(l_extendedprice) AS bottom FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    names = [("price", "top"), ("price", "bottom"), ("qty", "top")]
    cells = [F.max("l_extendedprice"), F.min("l_extendedprice"), F.max("l_quantity")]
    wide = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        *[a.alias("_".join(n)) for a, n in zip(cells, names, strict=True)]
    )
    return select.pick_level(wide, ["l_suppkey"], "price").toDF("l_suppkey", *select.flatten_columns(names[:2], 1))


@query(
    "cast",
    """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, TRY_CAST(event_type AS DOUBLE) AS as_number,
              CAST(user_id AS VARCHAR) AS user_text
       FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.col("event_type").alias("as_number"),
        F.col("user_id").alias("user_text"),
    )
    e = select.cast_cols(e, {"k": "bigint", "user_text": "string"})
    return select.cast_cols(e, {"as_number": "double"}, errors="null")


@query(
    "describe_schema",
    f"WITH {BARS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS col_name, '{k}' AS data_type, count(*) AS n_rows, count({c}) AS known_cells FROM bars"
        for c, k in {"ticker": "string", "bar_ts": "timestamp_ntz", **dict.fromkeys(VALUES, "double")}.items()
    ),
)
def _(spark, sf):
    return select.describe_schema(bars(spark, sf))


# -- filters -----------------------------------------------------------------


@query(
    "filter_bool",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
       WHERE (l_quantity < 5 OR l_quantity > 45) AND NOT l_returnflag = 'R'""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    small, big = F.col("l_quantity") < 5, F.col("l_quantity") > 45
    return filters.filter_rows(li, small | big, ~(F.col("l_returnflag") == "R"))


@query("filter_cols_by_stat", "SELECT p_partkey, p_retailprice FROM part WHERE p_size > 10")
def _(spark, sf):
    p = table(spark, sf, "part")
    return filters.filter_cols_by_stat(
        p, ["p_size", "p_retailprice"], F.avg, lambda v: v > 100, key=["p_partkey"], where=F.col("p_size") > 10
    )


@query(
    "mask_cells",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS p_size,
              CASE WHEN p_retailprice > 1000 THEN p_retailprice END AS p_retailprice FROM part""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return filters.mask_cells(p, {"p_size": F.col("p_size") > 25, "p_retailprice": F.col("p_retailprice") > 1000})


@query(
    "isin_cells",
    """SELECT c_custkey, c_nationkey IN (0, 3) AS c_nationkey, c_mktsegment = 'BUILDING' AS c_mktsegment,
              c_acctbal IN (0, 3) AS c_acctbal FROM customer""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").drop("c_name")
    return filters.isin_cells(c, ["c_nationkey", "c_mktsegment", "c_acctbal"], [0, 3, "BUILDING"])


@query(
    "where_else",
    f"""WITH {BARS}
    SELECT ticker, bar_ts, CASE WHEN close > open THEN volume ELSE 0.0 END AS up_volume,
           CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS direction,
           greatest(least(close, 100.0), 10.0) AS clipped
    FROM bars""",
)
def _(spark, sf):
    up, down = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    return bars(spark, sf).select(
        "ticker",
        "bar_ts",
        filters.where_else(up, F.col("volume"), 0.0).alias("up_volume"),
        filters.where_else(up, F.lit(1), filters.where_else(down, F.lit(-1), 0)).alias("direction"),
        filters.clip(F.col("close"), 10.0, 100.0).alias("clipped"),
    )


@query(
    "bool_reduce",
    """SELECT bool_and(l_quantity > 10) AS quantity_all, bool_and(l_tax >= 0) AS tax_all,
              bool_or(l_quantity > 10) AS quantity_any, bool_or(l_tax >= 0) AS tax_any,
              bool_or(l_quantity > 10) OR bool_or(l_tax >= 0) AS any_any FROM lineitem""",
)
def _(spark, sf):
    return filters.all_any(
        table(spark, sf, "lineitem"), {"quantity": F.col("l_quantity") > 10, "tax": F.col("l_tax") >= 0}
    )


@query(
    "enough_rows",
    """WITH u AS (SELECT user_id, date_trunc('hour', ts) AS bar_ts, max(value) AS high FROM events GROUP BY 1, 2)
       SELECT CAST(user_id AS VARCHAR) AS ticker, bar_ts, high FROM u
       WHERE user_id IN (SELECT user_id FROM u GROUP BY 1 HAVING count(*) >= 50)""",
)
def _(spark, sf):
    return filters.enough_rows(bars(spark, sf, ticker="user_id"), "ticker", 50).select("ticker", "bar_ts", "high")


# -- order, top rows, samples, duplicates ---------------------------------------


@query("sort_index", "SELECT n_name, n_nationkey, n_regionkey FROM nation ORDER BY n_name DESC")
def _(spark, sf):
    return ordering.sort_index(ordering.sort_columns(table(spark, sf, "nation"), ["n_name"]), ["n_name"], False)


@query("sort_values", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY 2, 3 DESC, 1")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ordering.sort_values(o, ["o_orderstatus", "o_totalprice", "o_orderkey"], [True, False, True])


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ordering.topk(o, "o_totalprice", 10, ["o_orderkey"])


@query("sample_rows", "SELECT * FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 10")
def _(spark, sf):
    return ordering.sample_rows(table(spark, sf, "orders"), 10, 42, ["o_orderkey"])


@query(
    "duplicated",
    """SELECT event_id, user_id, event_type,
              row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS duplicated FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ordering.duplicated(e, ["user_id", "event_type"], "event_id")


@query(
    "drop_duplicates",
    """SELECT event_id, user_id, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return ordering.drop_duplicates(e, ["user_id", "event_type"], "event_id")


@query(
    "drop_duplicates_last",
    "SELECT max(event_id) AS event_id, user_id, event_type FROM events GROUP BY 2, 3",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ordering.drop_duplicates(e, ["user_id", "event_type"], "event_id", keep="last")
