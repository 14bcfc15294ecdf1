"""Forests and boosted trees as tables, grown for all keys together.

A model is a table with a row per node: keys, ``tree``, ``node`` (numbered from 0 within its tree, level by level),
``feature`` (its place in the list of features, null in a leaf), ``threshold``, ``left``, ``right`` (node numbers), ``value``,
``gain`` and ``rows``.  A row goes left if its feature is null or not above the threshold.  Any such table can be scored,
also one that was made by hand.

Growing takes one job a level, whatever the number of keys and trees: rows find their node in each tree, and one aggregate
sums them by (keys, tree, node, feature, bin), combined before the shuffle, so neither a hot key nor a large one meets in
one task.  Sums are whole numbers (counts, or gradients in 2^-30), bins end at exact quantiles of their key, and bootstrap
weights and feature choices come from hashes, so a model is the same for any partitioning of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.joining import join_null_safe
from weftline.plans.quantile import quantiles
from weftline.plans.sizing import written

# Model sizes, seed, and the learning rate, leaf penalty and least curvature of boosting.
TREES, ROUNDS, SEED = 100, 100, 42
FOREST_DEPTH, BOOST_DEPTH = 5, 6
RATE, PENALTY, LEAST_CURVATURE = 0.3, 1.0, 1.0

BINS = 32
LEAST_GAIN = 1e-9
#: Gradients are sums of 2^-30, so that they add up exactly.
ONE = float(1 << 30)
#: Trees that are added up on the fly before a boosted model's scores are written.
FOLD = 10
#: Bootstrap weights of so many trees come from one digest (four hex digits each).
PER_DIGEST = 8

ALL = "__all"
NODE = ["feature", "threshold", "left", "right", "value"]


@dataclass(frozen=True)
class Rule:
    """How two sums ``a`` and ``b`` of a node are judged: what a side is worth, whether it may stand, and its value."""

    worth: Callable[[Column, Column], Column]
    stands: Callable[[Column, Column], Column]
    value: Callable[[Column, Column], Column]
    rows: Callable[[Column, Column], Column]


def gini(least_rows: int = 1) -> Rule:
    """Counts of both classes; the gain is the fall of the Gini impurity times the rows."""
    def worth(a, b):
        return (a * a + b * b).cast("double") / (a + b)

    return Rule(worth, lambda a, b: a + b >= least_rows, lambda a, b: b / (a + b), lambda a, b: a + b)


def second_order(rate: float = RATE, penalty: float = PENALTY, least: float = LEAST_CURVATURE) -> Rule:
    """Sums of gradients and curvatures; the gain is the fall of the penalised loss to second order."""
    def worth(a, b):
        g = a / F.lit(ONE)
        return g * g / (b / F.lit(ONE) + penalty) / 2

    def value(a, b):
        return -(a / F.lit(ONE)) / (b / F.lit(ONE) + penalty) * rate

    return Rule(worth, lambda a, b: b / F.lit(ONE) >= least, value, lambda a, b: F.lit(None).cast("bigint"))


# -- models -------------------------------------------------------------------------


def _model(nodes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: ``flat``, all nodes by tree and number, and ``trees``, where each begins and how many nodes it has."""
    flat = F.sort_array(F.collect_list(F.struct("tree", "node", *columns)))
    places = F.filter(F.transform("flat", lambda n, i: F.struct(n["tree"].alias("tree"), n["node"].alias("node"), i.alias("at"))), lambda n: n["node"] == 0)

    def span(tree: Column, i: Column) -> Column:
        end = F.coalesce(F.get("roots", i + 1)["at"], F.size("flat"))
        return F.struct(tree["tree"].alias("tree"), tree["at"].alias("at"), (end - tree["at"]).alias("size"))

    one = nodes.groupBy(*keys).agg(flat.alias("flat")).withColumn("roots", places)
    return one.select(*keys, "flat", F.transform("roots", span).alias("trees"))


def _follow(tree: Column, at: Column, x: Column, cut: str) -> Column:
    """The child of node ``at``; the node itself where it is a leaf, or not decided yet."""
    here = F.get("flat", tree["at"] + at)
    stays = (at >= tree["size"]) | here["feature"].isNull()
    right = F.coalesce(F.get(x, here["feature"]) > here[cut], F.lit(False))
    return F.when(stays, at).otherwise(here["left"] + right.cast("int"))


def _end(tree: Column, x: Column, cut: str, depth: int) -> Column:
    """Number of the node in which ``x`` ends after at most ``depth`` steps."""
    if not depth:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda at, _: _follow(tree, at, x, cut))


def _value(tree: Column, x: Column, cut: str, depth: int) -> Column:
    return F.get("flat", tree["at"] + _end(tree, x, cut, depth))["value"]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _features(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


@dataclass(frozen=True)
class Trees:
    """A node table with what is needed to apply it.  ``kind`` says how trees are put together: "mean" or "logistic"."""

    nodes: DataFrame
    features: tuple[str, ...]
    depth: int
    kind: str = "mean"
    keys: tuple[str, ...] = ()

    def _with_model(self, df: DataFrame) -> DataFrame:
        """Rows beside the trees of their key; rows of a key without a model are left out."""
        model = _model(self.nodes, self.keys, NODE)
        if self.keys:
            return join_null_safe(df, model, self.keys, "inner")
        # one row: a scalar subquery instead of a join
        return df.withColumn("__m", model.select(F.struct("flat", "trees")).scalar()).select("*", "__m.flat", "__m.trees").drop("__m")

    def score(self, df: DataFrame) -> DataFrame:
        """``probability`` of class 1 and ``prediction`` on every row; ``margin`` too where scores are added up."""
        x = _features(self.features)
        found = F.transform("trees", lambda t: _value(t, x, "threshold", self.depth))
        out = self._with_model(df).withColumn("margin", _total(found))
        if self.kind == "mean":
            out = out.withColumn("probability", F.col("margin") / F.size("trees")).drop("margin")
        else:
            out = out.withColumn("probability", _logistic(F.col("margin")))
        return out.withColumn("prediction", (F.col("probability") > 0.5).cast("int")).drop("flat", "trees")

    def contributions(self, df: DataFrame) -> DataFrame:
        """``base`` and, in ``c_<feature>``, how much the steps on each feature moved the score of a row.

        A step moves it by the difference of the values of the two nodes; base and contributions add up to the score (the
        probability, or the margin where scores are added up).  These are not Shapley values.
        """
        x, n = _features(self.features), len(self.features)
        nothing = F.array_repeat(F.lit(0.0), n)

        def along(tree: Column) -> Column:
            def step(state: Column, _: Column) -> Column:
                here = F.get("flat", tree["at"] + state["at"])
                to = _follow(tree, state["at"], x, "threshold")
                moved = F.get("flat", tree["at"] + to)["value"] - here["value"]
                own = F.transform(state["sums"], lambda s, i: F.when(here["feature"] == i, s + moved).otherwise(s))
                return F.struct(to.alias("at"), own.alias("sums"))

            start = F.struct(F.lit(0).alias("at"), nothing.alias("sums"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), start, step)["sums"]

        moved = F.aggregate(F.transform("trees", along), nothing, lambda s, t: F.zip_with(s, t, lambda a, b: a + b))
        base = _total(F.transform("trees", lambda t: F.get("flat", t["at"])["value"]))
        parts = F.lit(1.0) if self.kind != "mean" else F.size("trees")
        out = self._with_model(df).withColumns({"__moved": moved, "base": base / parts})
        each = {f"c_{c}": F.col("__moved")[i] / parts for i, c in enumerate(self.features)}
        return out.withColumns(each).drop("flat", "trees", "__moved")

    def importances(self) -> DataFrame:
        """Share of each feature in the gain of a tree, averaged over the trees of a key that have a split."""
        gains = self.nodes.filter(F.col("feature").isNotNull()).groupBy(*self.keys, "tree").agg(
            F.sum("gain").alias("all"),
            *[F.coalesce(F.sum(F.when(F.col("feature") == i, F.col("gain"))), F.lit(0.0)).alias(f"g{i}") for i in range(len(self.features))],
        )
        shares = gains.groupBy(*self.keys).agg(*[F.avg(F.col(f"g{i}") / F.col("all")).alias(f"g{i}") for i in range(len(self.features))])
        named = shares.withColumnsRenamed({f"g{i}": c for i, c in enumerate(self.features)})
        return named.unpivot(list(self.keys), list(self.features), "feature", "importance")


def _logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.exp(-margin) + 1)


# -- growing ------------------------------------------------------------------------


def bin_edges(rows: DataFrame, keys: Sequence[str], n: int, bins: int) -> DataFrame:
    """``edges`` of each key: for each feature the ``bins - 1`` inner quantiles of its known values."""
    long = rows.select(*keys, F.posexplode("x").alias("f", "v"))
    wanted = {f"q{i}": i / bins for i in range(1, bins)}
    ends = quantiles(long, [*keys, "f"], "v", wanted)
    own = ends.select(*keys, F.struct("f", F.array(*wanted).alias("edges")).alias("e"))
    return own.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["edges"]).alias("edges"))


def _binned(rows: DataFrame, edges: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """``bins``: for each feature, how many edges lie below the value; 0 for a missing one."""
    def place(i: int) -> Column:
        return F.size(F.filter(F.col("edges")[i], lambda e: e < F.col("x")[i])).cast("smallint")

    return join_null_safe(rows, edges, keys, "inner").withColumn("bins", F.array(*[place(i) for i in range(n)])).drop("edges")


def _chosen(trees: int, level: int, n: int, m: int, seed: int, rows: DataFrame) -> DataFrame:
    """The ``m`` features that each node of a level may split on: a table whose size is set by the parameters."""
    least, most = max(2 * level - 1, 0), (2 << level) - 1  # numbers that nodes of the level can have
    wide = most - least
    at = rows.sparkSession.range(trees * wide).select(
        F.floor(F.col("id") / wide).cast("int").alias("tree"), (F.col("id") % wide + least).cast("int").alias("node")
    )
    name = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda f: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in (F.col("tree"), F.col("node"), f)])).alias("h"), f.alias("f")),
    )
    return at.select("tree", "node", F.explode(F.slice(F.sort_array(name), 1, m)).alias("o")).select("tree", "node", F.col("o.f").alias("f"))


LEVEL = ["tree", "node", "feature", "bin", "left", "gain", "a", "b", "la", "lb", "ra", "rb"]


def _decided(cells: DataFrame, keys: Sequence[str], rule: Rule) -> DataFrame:
    """Of the sums by (keys, tree, node, f, bin): each node with its totals and, where it gains, its best split.

    Nodes are numbered level by level, so the j-th split of a level has its first child 2j behind the level's last node.
    Cells of a tree's level are as many as the parameters allow, and are dealt once for all that follows.
    """
    node = [*keys, "tree", "node"]
    cells = cells.repartition(*keys, "tree")
    each = Window.partitionBy(*node, "f").orderBy("bin")
    upto, all_bins = each.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*node, "f")
    both = cells.select(
        *node, "f", "bin", F.lead("bin").over(each).alias("more"), F.sum("a").over(upto).alias("la"), F.sum("b").over(upto).alias("lb"),
        F.sum("a").over(all_bins).alias("a"), F.sum("b").over(all_bins).alias("b"),
    )
    a, b, la, lb = (F.col(c) for c in ("a", "b", "la", "lb"))
    ra, rb = a - la, b - lb
    # a side without rows is worth nothing and ends before it is divided by
    may = F.col("more").isNotNull() & rule.stands(la, lb) & rule.stands(ra, rb)
    gain = F.when(may, rule.worth(la, lb) + rule.worth(ra, rb) - rule.worth(a, b))
    first = F.struct(
        F.when(gain > LEAST_GAIN, gain).alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"),
        la.alias("la"), lb.alias("lb"), ra.alias("ra"), rb.alias("rb"),
    )
    best = both.groupBy(*node).agg(F.max(first).alias("s"), F.any_value("a").alias("a"), F.any_value("b").alias("b"))
    splits = F.col("s.gain").isNotNull()
    of_tree = Window.partitionBy(*keys, "tree")
    before = F.count(F.when(splits, 1)).over(of_tree.orderBy("node")) - 1
    left = F.max("node").over(of_tree) + 1 + 2 * before
    return best.select(
        *node, F.when(splits, -F.col("s.f")).alias("feature"), F.when(splits, -F.col("s.bin")).alias("bin"),
        F.when(splits, left).cast("int").alias("left"), "s.gain", "a", "b", *[F.col(f"s.{c}") for c in ("la", "lb", "ra", "rb")],
    ).select(*keys, *LEVEL)


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def _finished(levels: Sequence[DataFrame], keys: Sequence[str], rule: Rule) -> DataFrame:
    """All nodes of trees that grow no further: the children of the last level are leaves."""
    sides = [F.struct((F.col("left") + k).alias("node"), F.col(f"{s}a").alias("a"), F.col(f"{s}b").alias("b")) for k, s in ((0, "l"), (1, "r"))]
    last = levels[-1].filter(F.col("left").isNotNull()).select(*keys, "tree", F.explode(F.array(*sides)).alias("o"))
    nodes = _union([*levels, last.select(*keys, "tree", "o.*")])
    a, b = F.col("a"), F.col("b")
    return nodes.select(
        *keys, "tree", "node", "feature", "bin", "left", (F.col("left") + 1).alias("right"), rule.value(a, b).alias("value"), "gain", rule.rows(a, b).alias("rows")
    )


def _node_table(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], named: bool) -> DataFrame:
    """Nodes with thresholds for bins, written."""
    threshold = F.get(F.get("edges", "feature"), F.col("bin").cast("int"))
    out = join_null_safe(nodes, edges, keys, "inner").select(
        *(keys if named else ()), "tree", "node", "feature", threshold.alias("threshold"), "left", "right", "value", "gain", "rows"
    )
    return written(out, "tree-nodes")


def _prepared(
    train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], bins: int, more: dict[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Training rows as keys, ``x``, ``bins``, ``y`` and ``more``, and the edges of their bins, both written."""
    y = F.col(f"`{label}`").cast("bigint")
    rows = train.filter(y.isNotNull()).select(*keys, _features(features).alias("x"), y.alias("y"), *[c.alias(n) for n, c in more.items()])
    if not keys:
        rows = rows.withColumn(ALL, F.lit(0))
    keys = keys or [ALL]
    rows = written(rows, "tree-rows")
    edges = written(bin_edges(rows, keys, len(features), bins), "tree-edges")
    # a row is worked on once for each tree and level, so rows are spread over more tasks than their size asks for
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(_binned(rows, edges, keys, len(features)).repartition(spread), "tree-bins"), edges


def bootstrap(row_key: Sequence[str], trees: int, seed: int) -> Column:
    """How often each tree draws a row: Poisson weights of mean 1 from a hash of the row's key."""
    ends, p, upto = [], math.exp(-1.0), 0.0
    for k in range(8):
        upto += p
        ends.append(int(upto * 65536))
        p /= k + 1
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row_key])
    def digits(digest: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(PER_DIGEST - 1)), lambda j: F.conv(F.substring(digest, j * 4 + 1, F.lit(4)), 16, 10).cast("int")
        )

    def of(d: Column) -> Column:
        # a list of one, so that the digest is worked out once for all its digits
        return F.flatten(F.transform(F.array(F.md5(F.concat_ws("|", F.lit(f"{seed}"), d.cast("string"), text))), digits))

    drawn = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(-(-trees // PER_DIGEST) - 1)), of))
    return F.transform(F.slice(drawn, 1, trees), lambda u: sum(((u >= e).cast("tinyint") for e in ends), F.lit(0).cast("tinyint")))


def forest(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    row_key: Sequence[str],
    keys: Sequence[str] = (),
    trees: int = TREES,
    depth: int = FOREST_DEPTH,
    bins: int = BINS,
    seed: int = SEED,
    per_node: int | None = None,
    least_rows: int = 1,
) -> Trees:
    """A forest for each of ``keys`` (or one of all rows), on 0/1 labels; rows without a label are left out.

    Each tree draws rows with replacement, by a hash of ``row_key`` (rows that share it are drawn together), and each node
    may split on ``per_node`` features (the root of their number).  A key whose rows a tree never draws has a tree fewer.
    """
    n, rule = len(features), gini(least_rows)
    per_node = per_node or max(int(math.sqrt(n)), 1)
    rows, edges = _prepared(train, features, label, list(keys), bins, {"w": bootstrap(row_key, trees, seed)})
    own = list(keys) or [ALL]
    levels: list[DataFrame] = []
    for level in range(depth):
        if level:
            placed = join_null_safe(rows, _model(_union(levels), own, ["feature", "bin", "left"]), own, "inner")
            at = F.transform("trees", lambda t: _open(t, _end(t, F.col("bins"), "bin", level)))  # noqa: B023
        else:
            placed = rows
            at = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.lit(0).alias("node")))
        live = F.filter(at, lambda s: s["node"].isNotNull() & (F.get("w", s["tree"]) > 0))
        each = placed.select(*own, "bins", "y", "w", F.explode(live).alias("s"))
        each = each.select(*own, "bins", "y", "s.*", F.get("w", F.col("s.tree")).cast("bigint").alias("n"))
        if per_node < n:
            # as many rows as trees, nodes of the level and features make
            each = each.join(F.broadcast(_chosen(trees, level, n, per_node, seed, rows)), ["tree", "node"])
            each = each.withColumn("bin", F.get("bins", "f"))
        else:
            each = each.select(*own, "y", "tree", "node", "n", F.posexplode("bins").alias("f", "bin"))
        cells = each.groupBy(*own, "tree", "node", "f", "bin").agg(F.sum(F.col("n") * (1 - F.col("y"))).alias("a"), F.sum(F.col("n") * F.col("y")).alias("b"))
        levels.append(written(_decided(cells, own, rule), "tree-level"))
    nodes = _node_table(_finished(levels, own, rule), edges, own, bool(keys))
    return Trees(nodes, tuple(features), depth, "mean", tuple(keys))


def _open(tree: Column, at: Column) -> Column:
    """The tree and, where it is not decided yet, the node."""
    return F.struct(tree["tree"].alias("tree"), F.when(at >= tree["size"], at).alias("node"))


def boost(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str] = (),
    rounds: int = ROUNDS,
    depth: int = BOOST_DEPTH,
    bins: int = BINS,
    rate: float = RATE,
    penalty: float = PENALTY,
    least: float = LEAST_CURVATURE,
) -> Trees:
    """Boosted trees for each of ``keys`` (or one model of all rows) by gradients and curvatures of the logistic loss.

    A round is a tree, so a job for each of its levels.  Scores start at 0; those of ``FOLD`` finished trees are written
    beside the rows, so that later rounds walk few trees.
    """
    rule = second_order(rate, penalty, least)
    rows, edges = _prepared(train, features, label, list(keys), bins, {"margin": F.lit(0.0)})
    own = list(keys) or [ALL]
    done: list[DataFrame] = []
    folded = 0  # finished trees that are in the written scores
    columns = ["feature", "bin", "left", "value"]

    def placed(tables: Sequence[DataFrame], turn: int) -> tuple[DataFrame, Column]:
        """Rows beside the trees of some tables, and their scores by the trees before ``turn``."""
        if not tables:
            return rows.withColumn("trees", F.lit(None)), F.col("margin")
        past = F.filter("trees", lambda t: t["tree"] < turn)
        score = F.col("margin") + _total(F.transform(past, lambda t: _value(t, F.col("bins"), "bin", depth)))
        return join_null_safe(rows, _model(_union(tables), own, columns), own, "inner"), score

    for turn in range(rounds):
        levels: list[DataFrame] = []
        for level in range(depth):
            growing = [t.withColumn("value", F.lit(None).cast("double")) for t in levels]
            beside, margin = placed([*done[folded:], *growing], turn)
            node = F.lit(0)
            if level:
                now = F.element_at("trees", -1)
                node = _open(now, _end(now, F.col("bins"), "bin", level))["node"]
            p = _logistic(F.col("margin"))
            live = beside.select(*own, "bins", "y", margin.alias("margin"), node.alias("node")).filter(F.col("node").isNotNull())
            slope, curve = F.round((p - F.col("y")) * ONE).cast("bigint"), F.round(p * (1 - p) * ONE).cast("bigint")
            each = live.select(*own, F.lit(turn).alias("tree"), "node", "bins", slope.alias("a"), curve.alias("b"))
            each = each.select(*own, "tree", "node", "a", "b", F.posexplode("bins").alias("f", "bin"))
            cells = each.groupBy(*own, "tree", "node", "f", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
            levels.append(written(_decided(cells, own, rule), "tree-level"))
        done.append(written(_finished(levels, own, rule), "tree"))
        if turn + 1 - folded == FOLD and turn + 1 < rounds:
            beside, margin = placed(done[folded:], turn + 1)
            rows = written(beside.withColumn("margin", margin).drop("flat", "trees"), "tree-bins")
            folded = turn + 1
    nodes = _node_table(_union(done), edges, own, bool(keys))
    return Trees(nodes, tuple(features), depth, "logistic", tuple(keys))
