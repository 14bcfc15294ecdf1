"""Plans for keys that fit no task must give whole and equal results; plans must prune and push down."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline import Line
from weftline.operators import groups, joins, ordering, select
from weftline.operators import series as S
from weftline.plans.quantile import quantiles
from weftline.plans.sizing import ROWS_PER_TASK_KEY
from weftline.sources import files


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, one value holds a third of them, one group is all null."""
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.8, "hot", "cold"),
            "v": np.where(rng.random(n) < 0.33, 5.0, np.round(rng.normal(0, 50, n), 2)),
            "id": rng.permutation(n),
        }
    )
    df = spark.createDataFrame(pdf)
    empty = spark.createDataFrame([("none", None, n + 1)], "k string, v double, id long")
    outlier = spark.createDataFrame([("cold", 1e12, n + 2)], "k string, v double, id long")
    return df.unionByName(empty).unionByName(outlier).repartition(6).cache()


Q = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.951, "e": 1.0}


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("limit", [300, 3])
def test_quantiles_by_bins(skewed, keys, limit):
    if limit == 3:  # bins that fit no task either
        skewed = skewed.filter("id < 60")
    plain = quantiles(skewed, keys, "v", Q).toPandas()
    cut = quantiles(skewed, keys, "v", Q, limit).toPandas()
    if keys:
        plain, cut = (d.sort_values("k", ignore_index=True) for d in (plain, cut))
    pd.testing.assert_frame_equal(plain, cut, rtol=1e-12)


def test_positions_over_the_whole_table(spark, skewed):
    spark.conf.set(ROWS_PER_TASK_KEY, "500")
    try:
        order = ["v", "id"]
        got = select.pos_slice(skewed.filter("v IS NOT NULL"), order, -7, -2).orderBy(*order).collect()
        mid = select.pos_slice(skewed.filter("v IS NOT NULL"), order, 1000, 1010).orderBy(*order).collect()
        at = select.pos_rows(skewed.filter("v IS NOT NULL"), order, [0, 2000]).orderBy(*order).collect()
        long = S.tail_per_key(skewed, ["k"], ["id"], 1500)
        sizes = {r["k"]: r["n"] for r in long.groupBy("k").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.unset(ROWS_PER_TASK_KEY)
    pdf = skewed.filter("v IS NOT NULL").toPandas().sort_values(order, ignore_index=True)
    assert [r.id for r in got] == pdf["id"].iloc[-7:-2].tolist()
    assert [r.id for r in mid] == pdf["id"].iloc[1000:1010].tolist()
    assert [r.id for r in at] == pdf["id"].iloc[[0, 2000]].tolist()
    n = skewed.groupBy("k").count().collect()
    assert sizes == {r["k"]: min(r["count"], 1500) for r in n}


def test_group_function_in_blocks(skewed):
    def add(pdf):
        out = pdf[["k", "id"]].copy()
        out["m"] = pdf["v"].rolling(3).sum()
        out["ahead"] = pdf["v"].shift(-1)
        return out

    schema = "k string, id long, m double, ahead double"
    plain = groups.group_rows(Line.of(skewed, "k", "id"), add, schema, before=2, after=1)
    cut = groups.group_rows(Line.of(skewed, "k", "id", 200), add, schema, before=2, after=1)
    a, b = (d.toPandas().sort_values(["k", "id"], ignore_index=True) for d in (plain, cut))
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_group_functions_do_not_follow_the_limit(spark, limit):
    df = spark.range(40).selectExpr("id % 4 AS k", "id AS t", "cast(id AS double) AS x")
    line = Line.of(df, "k", "t", limit)
    want = sorted((i % 4, i) for i in range(40) if i > 18 + i % 4)

    def above(pdf):
        return pdf.loc[pdf["x"] > pdf["x"].mean(), ["k", "t"]]

    got = groups.group_frames(line, above, "k long, t long")
    assert sorted((r.k, r.t) for r in got.collect()) == want
    with pytest.raises(Exception, match="rows for"):
        groups.group_rows(line, above, "k long, t long", before=1).collect()


def test_null_key_is_a_key(spark):
    df = spark.createDataFrame([(None if i % 3 else "a", i, float(i)) for i in range(60)], "k string, t int, x double")
    plain, cut = Line.of(df, "k", "t"), Line.of(df, "k", "t", 10)
    for line in (plain, cut):
        got = S.cumsum(line.with_position("p"), {"s": F.col("x")}).whole({"n": F.count("x")}).result()
        assert got.count() == 60 and got.agg(F.max("p")).first()[0] == 39
        assert {r.k: r.n for r in got.select("k", "n").distinct().collect()} == {None: 40, "a": 20}


def test_duplicates_do_not_gather_equal_rows(skewed):
    flags = ordering.duplicated(skewed.select("k", "v", "id"), ["k", "v"], "id")
    plan = flags._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    pdf = skewed.toPandas().sort_values("id")
    assert flags.filter("duplicated").count() == int(pdf.duplicated(["k", "v"]).sum())
    last = ordering.drop_duplicates(skewed.select("k", "v", "id"), ["k", "v"], "id", keep="last")
    want = pdf.drop_duplicates(["k", "v"], keep="last")["id"]
    assert sorted(r.id for r in last.collect()) == sorted(want)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_joins_with_a_hot_key(spark, how):
    a = spark.createDataFrame([(None if i % 7 == 0 else (1 if i % 3 else i), i) for i in range(60)], "k int, a int")
    b = spark.createDataFrame([(None if i % 9 == 0 else (1 if i % 2 else -i), i) for i in range(40)], "k int, b int")
    plain = joins.merge(a, b, "k", how).collect()
    three = joins.concat_cols([a, b, a.withColumnRenamed("a", "c")], "k").collect()
    spark.conf.set(ROWS_PER_TASK_KEY, "5")
    try:
        cut = joins.merge(a, b, "k", how).collect()
        three_cut = joins.concat_cols([a, b, a.withColumnRenamed("a", "c")], "k").collect()
    finally:
        spark.conf.unset(ROWS_PER_TASK_KEY)
    assert sorted(map(str, plain)) == sorted(map(str, cut))
    assert sorted(map(str, three)) == sorted(map(str, three_cut))
    pa, pb = a.toPandas(), b.toPandas()
    assert len(plain) == len(pa.merge(pb, on="k", how=how))


def test_scan_is_pruned_and_filtered(spark):
    df = files.scan_parquet(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey"], F.col("l_quantity") > 49)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double>", plan)


def test_no_query_has_a_cross_join(spark):
    from weftline.catalog import QUERIES

    for key in sorted(QUERIES):
        if key.startswith("ml_") or key in ("vol_regime", "main_verdict", "pooled_predictor"):
            continue  # they fit a model to make their plan
        plan = QUERIES[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, key
