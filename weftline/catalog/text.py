"""Scalar functions, text cleaning and user functions."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.catalog.registry import BARS, OVER, bar_line, bars, query, r, rounded, rs, table
from weftline.functions import dates, maths
from weftline.functions import text as X
from weftline.operators import groups, udf
from weftline.operators import stats
from weftline.sources import html

PRICE = "p_retailprice"


@query(
    "math_elementwise",
    f"""SELECT p_partkey, {rs({
        "exp": "exp(x)", "sqrt": "CASE WHEN x >= 0 THEN sqrt(x) END", "sign": "sign(x)", "abs": "abs(x)",
        "log": "CASE WHEN x > 0 THEN ln(x) END", "sin": "sin(x)", "tanh": "tanh(x)", "double": "x * 2"})}
    FROM (SELECT p_partkey, (p_size - 25) / 10 AS x FROM part)""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", ((F.col("p_size") - 25) / 10).alias("x"))
    return rounded(p.select("p_partkey", *[f(F.col("x")).alias(n) for n, f in maths.ELEMENTWISE.items()]))


@query(
    "str_concat",
    """SELECT c_custkey, c_name || ' ' || c_mktsegment AS plain,
              c_name || '-' || nullif(c_mktsegment, 'BUILDING') AS with_gap
       FROM customer""",
)
def _(spark, sf):
    gap = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        X.cat(F.col("c_name"), F.col("c_mktsegment"), " ").alias("plain"),
        X.cat(F.col("c_name"), gap, "-").alias("with_gap"),
    )


@query(
    "str_concat_list",
    """SELECT n_nationkey, n_name || '-' || CASE row_number() OVER (ORDER BY n_nationkey)
         WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' END AS joined FROM nation""",
)
def _(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return X.cat_list(n, "n_name", ["n_nationkey"], ["one", "two", "three"], "-").select("n_nationkey", "joined")


@query(
    "str_replace_regex",
    r"""SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]+', '-', 'g') AS ascii,
               regexp_replace(text, '([A-Z]+)', '', 'g') AS lower_only FROM documents""",
)
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        X.replace_regex(t, X.NOT_ASCII, "-").alias("ascii"),
        X.replace_regex(t, X.CAPITALS, "").alias("lower_only"),
    )


@query(
    "str_replace_literal",
    "SELECT doc_id, replace(replace(text, 'the', '°C'), '.', '') AS text FROM documents",
)
def _(spark, sf):
    t = X.replace_literal(X.replace_literal(F.col("text"), "the", "°C"), ".", "")
    return table(spark, sf, "documents").select("doc_id", t.alias("text"))


@query(
    "plain_quotes",
    "SELECT doc_id, regexp_replace(text, '[‘’]', '''', 'g') AS text FROM (SELECT doc_id, replace(text, 'th', '’') AS text FROM documents)",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.replace_literal(F.col("text"), "th", "’").alias("text"))
    return d.select("doc_id", X.plain_quotes(F.col("text")).alias("text"))


@query(
    "str_extract",
    """SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits,
              nullif(regexp_extract(c_mktsegment, '(U[A-Z])', 1), '') AS pair FROM customer""",
)
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        X.extract(F.col("c_name"), "([0-9]+)").alias("digits"),
        X.extract(F.col("c_mktsegment"), "(U[A-Z])").alias("pair"),
    )


@query(
    "str_predicates",
    r"""SELECT p_partkey, regexp_full_match(substr(p_brand, 7), '\p{Nd}+') AS brand_digits,
              regexp_full_match(p_brand, '[\p{L}\p{N}]+') AS brand_alnum, regexp_full_match(p_type, '[\p{L}\p{N}]+') AS type_alnum
       FROM part""",
)
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        X.isdigit(F.substr("p_brand", F.lit(7))).alias("brand_digits"),
        X.isalnum(F.col("p_brand")).alias("brand_alnum"),
        X.isalnum(F.col("p_type")).alias("type_alnum"),
    )


@query(
    "str_find",
    "SELECT p_partkey, CAST(strpos(p_name, 'ring') - 1 AS INTEGER) AS at, contains(p_name, 'ring') AS has_it FROM part",
)
def _(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", X.find(n, "ring").alias("at"), X.has(n, "ring").alias("has_it"))


@query(
    "str_split_get",
    """SELECT c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number, substr(c_name, 1, 5) AS head
       FROM customer""",
)
def _(spark, sf):
    n = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey",
        X.split_get(n, "#", 0).alias("kind"),
        X.split_get(n, "#", 1, 2).alias("number"),
        X.prefix(n, 5).alias("head"),
    )


@query(
    "str_case_trim",
    "SELECT p_partkey, lower(p_type) AS low, upper(p_name) AS up, p_brand AS bare FROM part",
)
def _(spark, sf):
    padded = F.concat(F.lit(" \t\n"), "p_brand", F.lit(" \n "))
    return table(spark, sf, "part").select(
        "p_partkey", F.lower("p_type").alias("low"), F.upper("p_name").alias("up"), X.strip(padded).alias("bare")
    )


@query(
    "to_date_parts",
    f"""WITH {BARS} SELECT ticker, bar_ts, CAST(bar_ts AS DATE) AS day, strftime(bar_ts, '%Y-%m-%d') AS day_text,
        CAST(CAST(bar_ts AS DATE) AS TIMESTAMP) AS midnight FROM bars""",
)
def _(spark, sf):
    b = bars(spark, sf).select("ticker", "bar_ts", dates.to_day(F.col("bar_ts")).alias("day"))
    b = b.withColumn("day_text", dates.day_text(F.col("bar_ts")))
    return b.withColumn("midnight", dates.parse_moment(F.col("day_text"), "yyyy-MM-dd").cast("timestamp_ntz"))


def weather_pages(spark, sf):
    """A page with one climate table per supplier; cells are tenths of its balance."""
    tenths = F.floor(F.col("s_acctbal") / 10)

    def cell(t):
        number = F.concat(F.floor(F.abs(t) / 10).cast("string"), F.lit("."), F.pmod(F.abs(t), F.lit(10)).cast("string"))
        return F.concat(F.lit("<td>"), F.when(t < 0, F.lit("−")).otherwise(""), number, F.lit(" (50.0)</td>"))

    def row(label, jan, feb):
        return F.concat(F.lit(f"<tr><th>{label}</th>"), cell(jan), cell(feb), F.lit("<td>0.0 (32.0)</td></tr>"))

    page = F.concat(
        F.lit("<h1>City</h1><table><tr><td>Other table</td></tr></table><table><tr><th>Climate data for "),
        "s_name",
        F.lit("</th></tr><tr><th>Month</th><th>Jan</th><th>Feb</th><th>Year</th></tr>"),
        row("Record high °C (°F)", tenths, tenths + 7),
        row("Record low °C (°F)", tenths - 1000, -tenths),
        F.lit("<tr><th>Source: &quot;records&quot;</th></tr></table>"),
    )
    return table(spark, sf, "supplier").select("s_suppkey", page.alias("html"))


@query(
    "climate_clean",
    f"""WITH t AS (SELECT s_suppkey, floor(s_acctbal / 10) AS t FROM supplier)
    SELECT s_suppkey, 'Jan' AS month, {r("t / 10", "record_high")}, {r("(t - 1000) / 10", "record_low")} FROM t
    UNION ALL SELECT s_suppkey, 'Feb', round((t + 7) / 10, 6) + 0.0, round(-t / 10, 6) + 0.0 FROM t""",
)
def _(spark, sf):
    cells = html.html_cells(weather_pages(spark, sf), "s_suppkey", "html", match="Climate data")
    months = ["Month", "Jan", "Feb"]
    wide = html.table_wide(cells, "s_suppkey", 1, months).filter(F.col("row_no") < 4)
    label = X.strip(X.replace_literal(X.split_get(F.col("Month"), "(", 0), "°C", ""))
    wide = wide.select("s_suppkey", label.alias("label"), *[X.measure(F.col(m)).alias(m) for m in months[1:]])
    long = wide.unpivot(["s_suppkey", "label"], months[1:], "month", "degrees")
    turned = long.groupBy("s_suppkey", "month").pivot("label", ["Record high", "Record low"]).agg(F.first("degrees"))
    return rounded(turned.toDF("s_suppkey", "month", "record_high", "record_low"))


@query(
    "message_decode",
    """WITH n AS (SELECT conv_id, role || length(text) AS word, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    l AS (SELECT conv_id, i AS line_no, i AS number, word FROM n
          UNION ALL SELECT conv_id, i + 1000000, i * 2 + 1, 'again ' || word FROM n),
    w AS (SELECT conv_id, number, arg_max(word, line_no) AS word FROM l GROUP BY 1, 2),
    t AS (SELECT conv_id, number, word, row_number() OVER (PARTITION BY conv_id ORDER BY number) AS place FROM w
          WHERE number IN (SELECT x * (x + 1) // 2 FROM range(1, 2000) k(x)))
    SELECT conv_id, coalesce(string_agg(word, ' ' ORDER BY number) FILTER (place * (place + 1) // 2 = number), '') AS decoded
    FROM t GROUP BY 1""",
)
def _(spark, sf):
    from weftline.plans.ordered import Line

    told = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat("role", F.length("text").cast("string")).alias("word")
    )
    n = Line.of(told, "conv_id", "turn").with_position("at").result().withColumn("i", F.col("at") + 1)

    def line(number, word):
        return F.concat(F.lit("  "), number.cast("string"), F.lit(" "), word, F.lit("\n"))

    lines = n.select("conv_id", F.col("i").alias("line_no"), line(F.col("i"), F.col("word")).alias("line")).unionByName(
        n.select(
            "conv_id",
            (F.col("i") + 1000000).alias("line_no"),
            line(F.col("i") * 2 + 1, F.concat(F.lit("again "), "word")).alias("line"),
        )
    )
    return X.decode_messages(lines, "conv_id", "line_no", "line")


# -- user functions --------------------------------------------------------------


@query(
    "udf_pipe",
    f"SELECT p_partkey, {r('p_size * 2.0 + 2 + p_retailprice', 'p_size')} FROM part",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    prices = table(spark, sf, "part").select("p_partkey", F.col(PRICE).alias("extra"))

    def twice(d):
        return udf.map_cells(d, ["p_size"], maths.double)

    def add(d, n):
        return udf.map_cells(d, ["p_size"], lambda c: c + n)

    def add_frame(d, other):
        return d.join(other, "p_partkey").select("p_partkey", (F.col("p_size") + F.col("extra")).alias("p_size"))

    return rounded(udf.pipe(p, twice, (add, 2), (add_frame, prices)))


@query("udf_pipe_scalar", "SELECT max(greatest(p_size, p_retailprice)) AS value FROM part")
def _(spark, sf):
    return udf.pipe(table(spark, sf, "part").select("p_size", PRICE), (stats.apply_all, ["p_size", PRICE]))


@query(
    "udf_map",
    "SELECT c_custkey, c_acctbal * 2 AS c_acctbal, c_nationkey * 2 AS c_nationkey FROM customer",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return udf.map_cells(c, ["c_acctbal", "c_nationkey"], maths.double)


@query("udf_map_python", "SELECT c_custkey, reverse(c_name) AS c_name FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return udf.map_cells_python(c, ["c_name"], lambda s: s[::-1], "string")


BOTH = {
    "p_size_sqrt": "sqrt(p_size)",
    "p_size_double": "p_size * 2.0",
    "p_retailprice_sqrt": "sqrt(p_retailprice)",
    "p_retailprice_double": "p_retailprice * 2",
}


def sized(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), PRICE)


@query("udf_transform", f"SELECT p_partkey, {rs(BOTH)} FROM part")
def _(spark, sf):
    pair = [("sqrt", maths.sqrt), ("double", maths.double)]
    return rounded(udf.transform(sized(spark, sf), ["p_partkey"], pair, ["p_size", PRICE]))


@query(
    "udf_agg_elementwise",
    f"SELECT p_partkey, {rs({'p_size': 'sqrt(p_size)', 'p_retailprice': 'p_retailprice * 2'})} FROM part",
)
def _(spark, sf):
    return rounded(
        udf.transform(sized(spark, sf), ["p_partkey"], {"p_size": maths.sqrt, PRICE: maths.double}, ["p_size", PRICE])
    )


@query(
    "udf_group",
    f"""WITH {BARS} SELECT ticker, bar_ts, {rs({
        "mean3": f"CASE WHEN count(*) {OVER[:-1]} ROWS 2 PRECEDING) = 3 THEN avg(close) {OVER[:-1]} ROWS 2 PRECEDING) END",
        "change": f"close - lag(close) {OVER}"})} FROM bars""",
)
def _(spark, sf):
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["ticker", "bar_ts"]].copy()
        out["mean3"] = pdf["close"].rolling(3).mean()
        out["change"] = pdf["close"].diff()
        return out

    schema = "ticker string, bar_ts timestamp_ntz, mean3 double, change double"
    out = groups.group_rows(bar_line(spark, sf), add, schema, before=2)
    return rounded(out.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("mean3", "change")}))


@query(
    "udf_group_whole",
    f"""WITH {BARS} SELECT ticker, bar_ts, close FROM bars QUALIFY close > avg(close) OVER (PARTITION BY ticker)""",
)
def _(spark, sf):
    def above(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.loc[pdf["close"] > pdf["close"].mean(), ["ticker", "bar_ts", "close"]]

    return groups.group_frames(bar_line(spark, sf), above, "ticker string, bar_ts timestamp_ntz, close double")


@query(
    "udf_group_stream",
    f"""WITH {BARS} SELECT ticker, bar_ts, {r("close / max(close) OVER (PARTITION BY ticker ORDER BY bar_ts) - 1", "fall")} FROM bars""",
)
def _(spark, sf):
    """How far each close lies below the highest so far: the state between batches is one number."""

    def falls(key, batches):
        top = float("-inf")
        for batch in batches:
            close = batch.column("close").to_numpy()
            tops = np.maximum(np.maximum.accumulate(close), top)
            top = tops[-1]
            yield pa.RecordBatch.from_arrays([batch.column("ticker"), batch.column("bar_ts"), pa.array(close / tops - 1)], ["ticker", "bar_ts", "fall"])

    rows = bars(spark, sf).select("ticker", "bar_ts", "close")
    return rounded(groups.group_stream(rows, ["ticker"], ["bar_ts"], falls, "ticker string, bar_ts timestamp_ntz, fall double"))


@query("udf_rows", f"SELECT p_partkey, {r('p_size + p_retailprice', 'total')}, {r('p_retailprice - p_size', 'gap')} FROM part")
def _(spark, sf):
    cols = ["p_size", PRICE]
    out = udf.map_rows(sized(spark, sf), lambda x: x["p_size"] + x[PRICE], cols, "total")
    out = udf.map_rows_python(out, lambda d: d[PRICE] - d["p_size"], cols, "gap", "double")
    return rounded(out.select("p_partkey", "total", "gap"))
