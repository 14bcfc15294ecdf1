"""HTML grids, CSV types, frames side by side, streamed groups, exact splits and the single mixture."""

import io
import math
import resource

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline import Line
from weftline.operators import groups, joins, paths
from weftline.operators import series as S
from weftline.sources import files, html

# -- HTML --------------------------------------------------------------------------


def grid_of(page):
    out = {}
    for no, r, c, text, _, head in html._grid(page):
        out.setdefault(no, {}).setdefault(r, []).append((c, text.strip(), head))
    return [[[t for _, t, _ in sorted(row)] for _, row in sorted(rows.items())] for _, rows in sorted(out.items())]


def test_spans_fill_their_places():
    page = """<table><tr><td rowspan=2>a<td colspan=2>b</tr><tr><td>c<td rowspan='0'>d</tr><tr><td>e<td>f</tr></table>
              <table><tr><td colspan=0>x<td colspan=oops>y</tr></table><table></table>"""
    assert grid_of(page) == [[["a", "b", "b"], ["a", "c", "d"], ["e", "f", "d"]], [["x", "y"]]]


def test_spans_end_with_their_section_and_table():
    page = "<table><thead><tr><th rowspan=0>h<th>i</thead><tbody><tr><td rowspan=9>a<td>b</tr></tbody></table><table><tr><td>z</tr></table>"
    assert grid_of(page) == [[["h", "i"], ["a", "b"]], [["z"]]]


def test_overlapping_spans_keep_the_earlier_cell():
    # the second row's wide cell runs into the place that the first row's tall cell holds
    page = "<table><tr><td>a<td rowspan=2>b<td>c</tr><tr><td colspan=3>d</tr></table>"
    assert grid_of(page) == [[["a", "b", "c"], ["d", "b", "d"]]]


def test_grid_equals_the_usual_reader(spark):
    """Against cells worked out by hand for a climate page with a head of two rows."""
    page = (
        "<table><tr><th rowspan=2>Month</th><th colspan=2>High</th><th>Low</th></tr><tr><th>mean</th><th>record</th><th>mean</th></tr>"
        "<tr><th>Jan</th><td>1.5</td><td>9</td><td>−3</td></tr><tr><th>Feb</th><td colspan=2>none</td><td>−1</td></tr></table>"
    )
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<p>no table"), (4, "<table><tr><td>1<td>2</table>")], "id int, html string")
    grid = html.html_grid(pages, "id", "html")
    got = {(r["id"], r["row_no"], r["col_no"]): (r["name"], r["text"]) for r in html.grid_records(grid, "id").collect()}
    want = {
        (1, 2, 0): ("Month", "Jan"), (1, 2, 1): ("High / mean", "1.5"), (1, 2, 2): ("High / record", "9"), (1, 2, 3): ("Low / mean", "−3"),
        (1, 3, 0): ("Month", "Feb"), (1, 3, 1): ("High / mean", "none"), (1, 3, 2): ("High / record", "none"), (1, 3, 3): ("Low / mean", "−1"),
        (4, 0, 0): ("", "1"), (4, 0, 1): ("", "2"),
    }
    assert got == want


def tasks_of(df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_pages_of_one_partition_are_parsed_once_by_many_tasks(spark):
    page = "<table><tr><td>menu</table><table><tr><th>\n Bal<b>ance </b><tr><td>5</table>"
    pages = spark.createDataFrame([(i, page) for i in range(200)], "id long, html string").coalesce(1)
    cells = html.html_cells(pages, "id", "html", match="Balance")
    assert tasks_of(cells) >= 8
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapIn") == 1 and "Join" not in plan
    want = html.tables_matching(html.html_cells(pages, "id", "html"), "id", "Balance")
    assert sorted(map(str, cells.collect())) == sorted(map(str, want.collect())) and cells.count() == 400


def test_ids_of_pages_stay_exact_beside_null(spark):
    large = 2**60 + 1
    pages = spark.createDataFrame([(large, "<table><tr><td>a"), (None, "<table><tr><td>b")], "id long, html string").coalesce(1)
    assert {(r["id"], r["text"]) for r in html.html_cells(pages, "id", "html").collect()} == {(large, "a"), (None, "b")}


def test_records_are_parsed_once_by_many_tasks(spark):
    texts = [
        "<table><thead><tr><th rowspan=2> a <th colspan=2>b</tr><tr><th>c<th>b</thead><tr><td rowspan=2>1<td>2<td>3<tr><td colspan=2>4</table>",
        "<table><tr><td>1<td>2</table><table></table><table><tr><th><th>x<tr><td>1<td>2</table>",
        "<table><tr><td>1<td>2<thead><tr><th>late<th>head</thead></table>",
        None,
    ]
    pages = spark.createDataFrame([(i, texts[i % 4]) for i in range(200)], "id long, html string").coalesce(1)
    records, grid = html.html_records(pages, "id", "html"), html.html_grid(pages, "id", "html")
    assert tasks_of(records) >= 8 and tasks_of(grid) >= 8
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapIn") == 1 and "Join" not in plan and "Aggregate" not in plan
    want = html.grid_records(grid, "id")
    assert records.columns == want.columns and sorted(map(str, records.collect())) == sorted(map(str, want.collect()))
    assert {r["name"] for r in records.filter("id = 0").collect()} == {"a", "b / c", "b"}


def test_a_registered_page_query_parses_once(spark):
    from weftline.catalog import QUERIES

    for key in ("html_tables", "html_grid", "climate_clean"):
        plan = QUERIES[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1, key


# -- CSV ---------------------------------------------------------------------------

CELLS = {
    "whole": ["1", "-2", "+3", " 4"], "gaps": ["1", "", "3", "NA"], "real": ["1.5", "2", ".5", "1e3"], "endless": ["inf", "-Infinity", "1", ""],
    "truth": ["True", "false", "TRUE", "False"], "some_truth": ["True", "", "False", "True"], "day": ["2020-01-05", "2020-02-29", "2021-12-31", ""],
    "mixed": ["1", "x", "2.5", "True"], "none": ["", "null", "n/a", "NaN"], "large": ["1", "99999999999999999999999", "2", "3"],
    "words": ["a", "NULLs", "None of it", "b"],
}


def test_inferred_types_and_values(spark, tmp_path):
    frame = pd.DataFrame(CELLS)
    path = tmp_path / "cells.csv"
    frame.to_csv(path, index=False)
    got = files.scan_csv(spark, str(path), infer=True)
    usual = pd.read_csv(io.StringIO(frame.to_csv(index=False)), skipinitialspace=True)
    kinds = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "str": "string"}
    types = dict(got.dtypes)
    for c in frame.columns:
        if c != "large":  # beyond 64 bits: a double here
            assert types[c] == kinds[str(usual[c].dtype)], c
    assert types["large"] == "double"
    for c in ("whole", "gaps", "real", "endless", "truth"):
        mine = [r[0] for r in got.select(c).collect()]
        assert [None if v is None else float(v) for v in mine] == [None if pd.isna(v) else float(v) for v in usual[c]], c
    dated = files.scan_csv(spark, str(path), infer=True, dates=True, index_col="day")
    assert dated.dtypes[0] == ("day", "date") and files.scan_csv(spark, str(path), infer=True, index_col=3).columns[0] == "endless"


def test_types_are_one_pass(spark):
    df = spark.createDataFrame([("1", "x")] * 3, "a string, b string")
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-pass", "one-pass")
    assert files.infer_types(df) == {"a": "bigint", "b": "string"}
    assert len(before.getJobIdsForGroup("one-pass")) <= 2  # an aggregate: its map side and its one row
    assert files.infer_types(df.limit(0)) == {"a": "double", "b": "double"}


# -- side by side ------------------------------------------------------------------


def test_five_frames_one_exchange(spark):
    made = [spark.range(20 * i, 20 * i + 40).select("id", (F.col("id") * i).alias("v"), F.lit("s").alias(f"t{i}")) for i in range(5)]
    out = joins.concat_cols(made, "id", repeats="refuse")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("ReusedExchange") == 1 and "Join" not in plan
    want = joins.concat_cols(made, "id")
    assert out.columns == want.columns and sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    inner = joins.concat_cols(made[:2], "id", "inner", repeats="refuse")
    assert sorted(r["id"] for r in inner.collect()) == list(range(20, 40))


def test_repeated_labels_are_refused(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "id int, x string")
    b = spark.createDataFrame([(1, "c"), (1, None)], "id int, y string")
    assert joins.concat_cols([a, a], "id", repeats="refuse").count() == 2  # null is a label
    with pytest.raises(PySparkException, match="repeated label 1 in frame 1"):
        joins.concat_cols([a, b], "id", repeats="refuse").collect()


# -- streamed groups ---------------------------------------------------------------


OUT = "k string, n bigint, biggest bigint, ordered boolean, peak bigint"


def test_a_group_is_read_in_batches(spark):
    def counted(key, batches):
        rows, biggest, ordered, last = 0, 0, True, None
        for batch in batches:
            at = batch.column("at").to_numpy()
            ordered &= bool((np.diff(at) > 0).all()) and (last is None or at[0] > last)
            last = at[-1]
            rows, biggest = rows + batch.num_rows, max(biggest, batch.num_rows)
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
        yield pa.RecordBatch.from_pydict({"k": [key[0]], "n": [rows], "biggest": [biggest], "ordered": [ordered], "peak": [peak]})

    n = 20_000_000  # far more rows than a batch, and more than fit beside each other as Python objects
    rows = spark.range(n, numPartitions=8).select(F.lit("hot").alias("k"), (F.lit(n) - F.col("id")).alias("at"), F.rand(1).alias("v"))
    few = spark.createDataFrame([(None, 2, 0.0), ("x", 1, 0.0), (None, 1, 0.0)], "k string, at long, v double")
    got = {r["k"]: r for r in groups.group_stream(rows.unionByName(few), ["k"], ["at"], counted, OUT).collect()}
    assert {k: r["n"] for k, r in got.items()} == {"hot": n, None: 2, "x": 1}
    assert all(r["ordered"] for r in got.values())
    assert got["hot"]["biggest"] <= 10_000 and got["hot"]["peak"] < 1024


def test_unread_rows_of_a_group_are_passed_over(spark):
    def first_only(key, batches):
        yield next(batches).select(["k", "at"]).slice(0, 1)

    rows = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"))
    got = groups.group_stream(rows, ["k"], ["at"], first_only, "k long, at long")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0), (1, 1), (2, 2)]


# -- exact splits ------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 5, 11, 1000])
def test_split_is_exact(spark, n):
    rows = spark.range(n).select((F.col("id") % 7 if n > 500 else F.col("id")).alias("k"), (F.col("id") % 50).alias("v"))
    train, test = S.split_exact(rows, ["k"])
    assert (train.count(), test.count()) == (n - math.ceil(0.2 * n), math.ceil(0.2 * n))
    assert sorted(map(str, train.unionByName(test).collect())) == sorted(map(str, rows.collect()))
    again = S.split_exact(rows.repartition(5), ["k"])[1]
    assert sorted(map(str, again.collect())) == sorted(map(str, test.collect()))


def test_split_among_equal_rows(spark):
    rows = spark.range(3000).select(F.lit(1).alias("k"), F.lit("same").alias("v"))
    for share in (0.0, 0.5, 1.0):
        train, test = S.split_exact(rows, ["k"], share)
        assert (train.count(), test.count()) == (3000 - 3000 * share, 3000 * share)


# -- one mixture -------------------------------------------------------------------


def test_mixture_finds_two_planted_regimes(spark):
    rng = np.random.default_rng(4)
    spread = np.repeat([0.01, 0.08, 0.01], 200)
    rows = [("s", i, float(x)) for i, x in enumerate(rng.normal(0, 1, 600) * spread)]
    line = Line.of(spark.createDataFrame(rows, "k string, at int, log_ret double"), "k", "at")
    got = paths.vol_regime(line, use_rolling_vol=True).collect()
    wild = {r["at"]: r["regime"] for r in got}
    assert np.mean([wild[i] for i in range(210, 400)]) > 0.9 and np.mean([wild[i] for i in range(4, 190)]) < 0.05
    assert paths.vol_regime(Line.of(line.df.limit(0), "k", "at")).count() == 0


def test_trend_score_with_paths_of_one_event(spark, tmp_path):
    """A path of one event has no slope: it takes no part, and a ticker that has no others keeps its row without a signal."""
    from weftline.catalog import QUERIES

    at = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 7 as int))"
    value = "((id * 37) % 101) / 7.0D + 1"
    events = spark.range(400).selectExpr("id AS event_id", f"{at} AS ts", "id % 7 AS user_id", "'usual' AS event_type", f"{value} AS value")
    lone = spark.range(400).selectExpr("id + 400", f"{at}", "id + 100", "'lone'", f"{value}")
    one = spark.range(1).selectExpr("id + 900", "timestamp_ntz'2024-01-02 00:00:30'", "id + 50", "'usual'", "5.0D")

    def scores(name, *parts):
        made = parts[0]
        for part in parts[1:]:
            made = made.union(part)
        made.withColumn("props", F.lit('{"k": 1}')).write.parquet(str(tmp_path / name / "events.parquet"))
        return {r["ticker"]: r for r in QUERIES["trend_score"](spark, str(tmp_path / name)).collect()}

    got = scores("lone", events, lone)
    assert set(got) == {"usual", "lone"} and got["lone"]["signal"] is None and got["lone"]["vol"] > 0
    assert abs(got["usual"]["signal"]) < 1
    # one more event, of a user who has no other, changes no slope
    with_one = scores("one", events, one)["usual"]
    assert with_one["signal"] is not None and abs(with_one["signal"]) < 1
