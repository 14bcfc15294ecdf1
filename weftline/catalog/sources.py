"""Sources and sinks."""

from pyspark.sql import functions as F

from weftline.catalog.registry import BARS, bars, grid, query, rounded, rs, table
from weftline.catalog.registry import GRID as GRID_SQL
from weftline.plans.sizing import scratch
from weftline.sources import files, frames, html

VALUES = ["open", "high", "low", "close", "volume"]


@query("bars", f"WITH {BARS} SELECT ticker, bar_ts, {rs(VALUES)} FROM bars")
def _(spark, sf):
    return rounded(bars(spark, sf))


@query("bars_grid", f"WITH {GRID_SQL} SELECT ticker, bar_ts, {rs(VALUES)} FROM grid")
def _(spark, sf):
    return rounded(grid(spark, sf))


@query(
    "scan_parquet",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'",
)
def _(spark, sf):
    return files.scan_parquet(
        spark,
        f"{sf}/orders.parquet",
        ["o_orderkey", "o_custkey", "o_totalprice"],
        (F.col("o_totalprice") > 400000) & (F.col("o_orderstatus") == "F"),
        view="scanned_orders",
    )


@query("sink_parquet", f"WITH {BARS} SELECT ticker, bar_ts, {rs(VALUES)} FROM bars")
def _(spark, sf):
    path = scratch(spark, "bars")
    files.cached(spark, path, lambda: bars(spark, sf), by=["ticker"])
    again = files.cached(spark, path, lambda: bars(spark, sf), by=["ticker"])
    return rounded(again)


@query("register_table", f"WITH {BARS} SELECT ticker, count(*) AS n FROM bars GROUP BY ticker")
def _(spark, sf):
    files.register_table(bars(spark, sf), "bar_data")
    return spark.sql("SELECT ticker, count(*) AS n FROM bar_data GROUP BY ticker")


@query(
    "scan_csv",
    """SELECT c_custkey, c_name, CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS c_nationkey, c_acctbal,
              nullif(c_mktsegment, 'BUILDING') AS c_mktsegment
       FROM customer""",
)
def _(spark, sf):
    path = scratch(spark, "customer-csv")
    told = table(spark, sf, "customer").withColumn(
        "c_nationkey", F.when(F.col("c_nationkey") == 7, "Not Known").otherwise(F.col("c_nationkey").cast("string"))
    )
    told.write.option("header", True).csv(path)
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return files.scan_csv(spark, path, schema, na_values=["Not Known", "BUILDING"])


@query(
    "scan_csv_raw",
    """SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN '' WHEN c_nationkey = 8 THEN 'NA' ELSE c_nationkey::VARCHAR END AS nation
       FROM customer""",
)
def _(spark, sf):
    """Chosen columns, every cell as it is written: empty ones stay empty, and no token is missing."""
    path = scratch(spark, "customer-csv")
    nation = F.when(F.col("c_nationkey") == 7, "").when(F.col("c_nationkey") == 8, "NA").otherwise(F.col("c_nationkey").cast("string"))
    told = table(spark, sf, "customer").select("c_custkey", "c_name", nation.alias("nation"))
    told.write.option("header", True).csv(path)
    schema = "c_custkey long, c_name string, nation string"
    return files.scan_csv(spark, path, schema, columns=["c_custkey", "nation"], na_values=["NA"], na_filter=False)


@query("scan_csv_nrows", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 70")
def _(spark, sf):
    """The first rows in the order of the files."""
    path = scratch(spark, "customer-csv")
    table(spark, sf, "customer").orderBy("c_custkey").write.option("header", True).csv(path)
    schema = ", ".join(f"{c} {t}" for c, t in table(spark, sf, "customer").dtypes)
    return files.scan_csv(spark, path, schema, columns=["c_custkey", "c_acctbal"], nrows=70)


@query(
    "html_tables",
    """
    SELECT c_custkey AS page_id, 1 AS table_no, 0 AS row_no, h.c AS col_no, h.t AS text, true AS is_header
    FROM customer, (VALUES (0, 'Name'), (1, 'Balance')) h(c, t)
    UNION ALL SELECT c_custkey, 1, 1, 0, c_name || ' & Co', false FROM customer
    UNION ALL SELECT c_custkey, 1, 1, 1, 'n' || c_nationkey, false FROM customer
    """,
)
def _(spark, sf):
    page = F.concat(
        F.lit("<html><body><table><tr><td>menu</td></tr></table><p>text</p><table class='x'><tr><th>Name</th><th> <b>Bal</b>ance</th></tr><tr><td>"),
        "c_name",
        F.lit(" &amp; Co</td><td>\n n"),
        F.col("c_nationkey").cast("string"),
        F.lit("</td></tr></table></body></html>"),
    )
    pages = table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"), page.alias("html"))
    return html.html_cells(pages, "page_id", "html", match="Balance")


@query(
    "scan_csv_inferred",
    """SELECT c_custkey, CASE WHEN c_nationkey <> 7 THEN c_nationkey END::DOUBLE AS gaps, c_acctbal AS amount, c_nationkey > 10 AS far,
              (DATE '2020-01-01' + c_nationkey::INTEGER) AS day, CASE WHEN c_nationkey = 3 THEN 'x' ELSE c_nationkey::VARCHAR END AS mixed,
              c_nationkey::BIGINT AS whole
       FROM customer""",
)
def _(spark, sf):
    """Types found in the cells: whole numbers with and without gaps, numbers, truth values, days, and text; a label column."""
    path = scratch(spark, "customer-csv")
    nation = F.col("c_nationkey")
    told = table(spark, sf, "customer").select(
        F.when(nation == 7, "N/A").otherwise(nation.cast("string")).alias("gaps"),
        F.col("c_acctbal").alias("amount"),
        F.when(nation > 10, "True").otherwise("False").alias("far"),
        F.date_add(F.lit("2020-01-01"), nation.cast("int")).alias("day"),
        F.when(nation == 3, "x").otherwise(nation.cast("string")).alias("mixed"),
        nation.alias("whole"),
        "c_custkey",
    )
    told.write.option("header", True).csv(path)
    return files.scan_csv(spark, path, infer=True, dates=True, index_col="c_custkey")


@query(
    "html_grid",
    """
    SELECT s_suppkey AS page_id, 0 AS table_no, (2 + k)::INTEGER AS row_no, c::INTEGER AS col_no,
           ['Supplier', 'Account / Balance', 'Account / Nation'][c + 1] AS name,
           CASE WHEN c = 0 THEN s_name WHEN c = 1 AND k = 0 THEN CAST(s_suppkey AS VARCHAR) WHEN c = 2 AND k = 0 THEN 'n' || s_nationkey ELSE 'none' END AS text
    FROM supplier, range(2) r(k), range(3) x(c)
    """,
)
def _(spark, sf):
    """A head of two rows and spans in both directions: every place of the body with the name of its column."""
    page = F.concat(
        F.lit("<table><thead><tr><th rowspan=2>Supplier</th><th colspan='2'>Account</th></tr><tr><th>Balance</th><th>Nation</th></tr></thead>"),
        F.lit("<tbody><tr><td rowspan=2>"), "s_name", F.lit("</td><td>"), F.col("s_suppkey").cast("string"), F.lit("</td><td>n"),
        F.col("s_nationkey").cast("string"), F.lit("</td></tr><tr><td colspan=2>none</td></tr></tbody></table>"),
    )
    pages = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), page.alias("html"))
    return html.html_records(pages, "page_id", "html")


@query(
    "html_list_items",
    r"""
    SELECT page_id, CAST(row_no - 1 AS INTEGER) AS row_no, text FROM (
      SELECT page_id, unnest(m) AS text, generate_subscripts(m, 1) AS row_no
      FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS m FROM pages)
    )""",
)
def _(spark, sf):
    items = html.html_cells(table(spark, sf, "pages"), "page_id", "html", kind="list")
    return items.select("page_id", "row_no", "text")


@query(
    "relative_period",
    f"""WITH {BARS}
    SELECT ticker, bar_ts, {rs(VALUES)}
    FROM (SELECT *, max(bar_ts) OVER (PARTITION BY ticker) AS top FROM bars)
    WHERE bar_ts >= top - INTERVAL 5 DAY""",
)
def _(spark, sf):
    return rounded(files.relative_period(bars(spark, sf), "5d"))


@query(
    "build_frame",
    """SELECT c_custkey, c_mktsegment AS label,
              CASE c_mktsegment WHEN 'BUILDING' THEN 12 WHEN 'MACHINERY' THEN -1 WHEN 'FURNITURE' THEN 7 END AS value,
              4 AS four
       FROM customer""",
)
def _(spark, sf):
    labels = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"))
    found = frames.lookup(labels, "label", {"BUILDING": 12, "MACHINERY": -1, "FURNITURE": 7, "NONE": 3})
    return frames.constant(found, 4, "four")


@query(
    "ticker_union",
    f"""WITH {BARS} SELECT 'event_type' AS source, ticker, bar_ts, {rs(VALUES)} FROM bars
    UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), date_trunc('hour', ts), {", ".join(f"round({c}, 6) + 0.0" for c in (
        "first(value ORDER BY ts, event_id)", "max(value)", "min(value)", "last(value ORDER BY ts, event_id)",
        "sum(CAST(props->>'$.k' AS DOUBLE))"))}
    FROM events WHERE user_id IS NOT NULL GROUP BY 2, 3""",
)
def _(spark, sf):
    """Every input of a dictionary under its name; the empty one vanishes."""
    parts = {by: bars(spark, sf, ticker=by) for by in ("event_type", "user_id")}
    return rounded(files.union_keyed({**parts, "absent": parts["user_id"].limit(0)}, "source"))
