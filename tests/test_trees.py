"""Forests and boosted trees as tables: planted rules, any partitioning, keys apart, contributions, tables made by hand."""

from uuid import uuid4

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import trees as T

NAMES = list("abcd")
SCHEMA = "id long, k string, a double, b double, c double, d double, y int"


@pytest.fixture(scope="module")
def planted(spark):
    """Class 1 where exactly one of two features is high: no single split tells anything; d is noise, c is missing at times."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > -0.1)).astype(int)
    rows = [
        (i, "xyz"[i % 3] if i % 7 else None, *(float(v) for v in x[i, :2]), None if i % 11 == 0 else float(x[i, 2]), float(x[i, 3]), int(y[i]))
        for i in range(len(x))
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def table_of(model):
    return sorted((tuple(r) for r in model.nodes.collect()), key=repr)


def right(scored):
    return scored.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]


def test_forest_finds_a_planted_rule(planted):
    train, test = planted.filter("id % 5 > 0"), planted.filter("id % 5 = 0")
    model = T.forest(train, NAMES, "y", ["id"], trees=10, depth=4, per_node=3)
    assert right(model.score(test)) > 0.93
    weight = {r["feature"]: r["importance"] for r in model.importances().collect()}
    assert weight["a"] + weight["b"] > 0.9 and sum(weight.values()) == pytest.approx(1)
    # the same rows in other partitions give the same table
    again = T.forest(train.repartition(11), NAMES, "y", ["id"], trees=10, depth=4, per_node=3)
    assert table_of(again) == table_of(model)
    # the steps of a row add up to its score
    scored = model.contributions(model.score(test))
    off = F.abs(F.col("base") + sum((F.col(f"c_{c}") for c in NAMES), F.lit(0.0)) - F.col("probability"))
    assert scored.agg(F.max(off)).first()[0] < 1e-12
    assert scored.count() == test.count()


def test_keys_grow_apart(planted):
    """A key's trees are those that its rows alone give; null is a key like others."""
    train = planted.filter("id % 5 > 0")
    both = T.forest(train, NAMES, "y", ["id"], keys=["k"], trees=4, depth=3)
    assert both.nodes.select("k").distinct().count() == 4
    alone = T.forest(train.filter("k = 'y'"), NAMES, "y", ["id"], trees=4, depth=3)
    mine = both.nodes.filter("k = 'y'").drop("k")
    assert sorted(map(repr, mine.collect())) == sorted(map(repr, alone.nodes.collect()))
    assert both.score(planted).count() == planted.count()


def jobs_of(spark, run):
    group = f"trees-{uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_many_keys_take_no_more_levels(spark):
    """Thousands of keys are grown by the same writes as two (adaptive execution may add a job for a broadcast)."""
    few = spark.range(4000).selectExpr("id", "id % 2 AS k", "pmod(xxhash64(id), 100) / 10 AS a", "pmod(xxhash64(id), 100) % 2 AS y")
    many = few.withColumn("k", F.col("id") % 2000)
    n = [jobs_of(spark, lambda d=d: T.forest(d, ["a"], "y", ["id"], keys=["k"], trees=2, depth=2)) for d in (few, many)]
    assert n[1] <= 1.5 * n[0]


def loss(scored):
    p = F.when(F.col("y") == 1, F.col("probability")).otherwise(1 - F.col("probability"))
    return scored.agg(F.avg(-F.log(p))).first()[0]


def test_boost_lowers_the_loss_each_round(planted, monkeypatch):
    monkeypatch.setattr(T, "FOLD", 2)  # scores are written in between
    model = T.boost(planted, NAMES, "y", rounds=4, depth=3)
    falls = []
    for rounds in range(1, 5):
        part = T.Trees(model.nodes.filter(F.col("tree") < rounds), model.features, model.depth, model.kind)
        falls.append(loss(part.score(planted)))
    assert falls == sorted(falls, reverse=True) and falls[0] < np.log(2) and falls[-1] < 0.45
    scored = model.contributions(model.score(planted))
    off = F.abs(F.col("base") + sum((F.col(f"c_{c}") for c in NAMES), F.lit(0.0)) - F.col("margin"))
    assert scored.agg(F.max(off)).first()[0] < 1e-12
    assert right(scored) > 0.9


def test_boosted_keys_grow_apart(planted):
    both = T.boost(planted, NAMES, "y", keys=["k"], rounds=2, depth=2)
    alone = T.boost(planted.filter("k = 'y'"), NAMES, "y", rounds=2, depth=2)
    mine = both.nodes.filter("k = 'y'").drop("k")
    assert sorted(map(repr, mine.collect())) == sorted(map(repr, alone.nodes.collect()))
    assert T.boost(planted.limit(0), NAMES, "y", rounds=2, depth=2).nodes.count() == 0


def test_tiny_inputs(spark):
    rows = spark.createDataFrame([(1, "x", 1.0, 1.0, 1.0, 1.0, 1), (2, "x", 1.0, 1.0, 1.0, 1.0, None)], SCHEMA)
    model = T.forest(rows, NAMES, "y", ["id"], trees=6, depth=2)
    assert {r["value"] for r in model.nodes.collect()} == {1.0}  # one row: leaves only
    assert [r["probability"] for r in model.score(rows).collect()] == [1.0, 1.0]
    assert T.forest(rows.limit(0), NAMES, "y", ["id"], trees=2, depth=2).nodes.count() == 0


def test_table_made_by_hand(spark):
    nodes = [(0, 0, 0, 2.0, 1, 2, 0.5), (0, 1, None, None, None, None, 0.1), (0, 2, None, None, None, None, 0.9)]
    table = spark.createDataFrame(nodes, "tree int, node int, feature int, threshold double, left int, right int, value double")
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (None,)], "a double")
    got = T.Trees(table, ("a",), 1).score(rows).collect()
    assert [(r["a"], r["probability"], r["prediction"]) for r in got] == [(1.0, 0.1, 0), (2.0, 0.1, 0), (2.5, 0.9, 1), (None, 0.1, 0)]
