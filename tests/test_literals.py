"""Small frames with rows worked out by hand."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weftline import Line
from weftline.functions import maths
from weftline.functions import text as X
from weftline.operators import (
    clean,
    decide,
    filters,
    groups,
    joins,
    labelled,
    paths,
    reshape,
    select,
    stats,
    udf,
)
from weftline.operators import series as S
from weftline.sources import files, frames, html


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def grid3(spark):
    return frames.frame(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]], ["A", "B", "C"], ["a", "b", "c"])


@pytest.fixture(scope="module")
def multi4(spark):
    data = [[4 * i + j for j in range(1, 5)] for i in range(4)]
    df = frames.frame(spark, data, ["X_A", "X_B", "Y_A", "Y_B"], ["xa", "xb", "ya", "yb"])
    return df.withColumns({"first": F.substring("label", 1, 1), "second": F.substring("label", 2, 1)}).drop("label")


@pytest.fixture(scope="module")
def pivot6(spark):
    data = [("oak", "n", 4, 7), ("oak", "n", 1, 5), ("ash", "s", 3, 2), ("oak", "s", 6, 1), ("oak", "s", 2, 8), ("ash", "n", 9, 3)]
    return spark.createDataFrame(data, "A string, B string, C int, D int")


ABC = ["A", "B", "C"]


def test_repeated_labels(spark):
    s = frames.series(spark, [5, 9, 11, -1, 4], ["a", "b", "c", "d", "a"])
    assert sorted(r.value for r in select.label_rows(s, "label", ["a"]).collect()) == [4, 5]


def test_lookup(spark):
    labels = frames.series(spark, [0, 0, 0], ["a", "b", "e"]).select("label")
    got = frames.lookup(labels, "label", {"a": 12, "b": -1, "c": 7, "d": 3})
    assert rows(got, "label") == [("a", 12), ("b", -1), ("e", None)]


def test_constructors(spark):
    assert rows(frames.arange(spark, 1, 6), "value") == [(i,) for i in range(1, 6)]
    assert rows(frames.zeros(spark, 2, ["A", "B"]), "label") == [(0, 0.0, 0.0), (1, 0.0, 0.0)]
    assert frames.randoms(spark, 20, ABC, 1).filter("A >= 0 AND A < 1").count() == 20
    assert frames.randoms(spark, 5, ["A"], 1, normal=True).count() == 5


def test_pick_level(spark):
    data = [(1, 2, 3, -1, -2), (4, 5, 6, -3, -4), (7, 8, 9, -5, -6)]
    df = frames.frame(spark, data, ["X_A", "X_B", "X_C", "Y_D", "Y_E"], ["a", "b", "c"])
    assert rows(select.pick_level(df, ["label"], "X"), "label") == [("a", 1, 2, 3), ("b", 4, 5, 6), ("c", 7, 8, 9)]
    assert select.flatten_columns([("Close", "KO"), "Date"]) == ["Close", "Date"]
    assert select.pick_low_level(df, ["label"], "A").columns == ["label", "X"]


def test_grid3(grid3):
    line = Line.of(grid3, (), "label")
    moved = line.roll(lambda d, f: d.withColumns({c: S.shift(F.col(c), 1, f) for c in ABC}), 1).result()
    assert rows(moved, "label") == [("a", None, None, None), ("b", 1, 2, 3), ("c", 4, 5, 6)]
    right = clean.shift_cols(grid3, ABC, 1, "long")
    assert rows(right, "label") == [("a", None, 1, 2), ("b", None, 4, 5), ("c", None, 7, 8)]
    assert rows(stats.apply_cols(grid3, ABC, stats.STATS["range"])) == [(6, 6, 6)]
    assert [r[0] for r in rows(grid3.orderBy("label").select(stats.row_range(ABC)))] == [2, 2, 2]
    assert [r[0] for r in rows(grid3.orderBy("label").select(stats.row_sum(ABC)))] == [6, 15, 24]
    assert rows(stats.agg_map(grid3, {c: "sum" for c in ABC})) == [(12, 15, 18)]
    assert rows(stats.agg_list(grid3, ABC, ["mean"])) == [("mean", 4.0, 5.0, 6.0)]
    roots = [r[1] for r in rows(udf.transform(grid3, ["label"], maths.sqrt, ["A"]), "label")]
    assert roots == pytest.approx([1, 2, 2.6457513])


def test_transform_keeps_its_shape(grid3):
    with pytest.raises(AnalysisException):
        udf.transform(grid3, ["label"], F.max, ["A"]).collect()
    with pytest.raises(AnalysisException):
        udf.transform(grid3, [], F.max, ["A"]).collect()


def test_isin3(spark):
    df = frames.frame(spark, [[0, 1, 2], [3, 4, 5], [6, 7, 8]], ABC, ["0", "1", "2"])
    hits = rows(filters.isin_cells(df, ABC, [0, 3]), "label")
    assert hits == [("0", True, False, False), ("1", True, False, False), ("2", False, False, False)]
    kept = filters.mask_cells(df, {c: F.col(c).isin(0, 3) for c in ABC})
    kept = clean.dropna_cols(clean.dropna(kept, thresh=1, subset=ABC), ABC)
    assert rows(kept, "A") == [(0,), (3,)]


def test_levels(multi4):
    cells = ["X_A", "X_B", "Y_A", "Y_B"]
    assert rows(groups.group_level(multi4, "first", cells), "first") == [("x", 5, 6, 7, 8), ("y", 13, 14, 15, 16)]
    assert rows(groups.group_level(multi4, "second", cells), "second") == [("a", 9, 10, 11, 12), ("b", 13, 14, 15, 16)]
    keys = ["first", "second"]
    assert [r[2:] for r in rows(groups.group_level_cols(multi4, keys, 0), *keys)] == [(2, 4), (6, 8), (10, 12), (14, 16)]
    assert [r[2:] for r in rows(groups.group_level_cols(multi4, keys, 1), *keys)] == [(3, 4), (7, 8), (11, 12), (15, 16)]
    down = rows(reshape.stack_level(multi4, keys), *keys, "level")
    assert down[:2] == [("x", "a", "A", 1, 3), ("x", "a", "B", 2, 4)]


def test_pivots(pivot6):
    sums = rows(reshape.pivot_table(pivot6, ["A"], "B", {"C": "sum", "D": "sum"}), "A")
    assert sums == [("ash", 9, 3, 3, 2), ("oak", 5, 8, 12, 9)]
    many = reshape.pivot_table(pivot6, ["A"], "B", {"C": "sum", "D": ["min", "max", "mean"]})
    assert many.columns == ["A", "C_n", "C_s", "D_min_n", "D_min_s", "D_max_n", "D_max_s", "D_mean_n", "D_mean_s"]
    assert rows(many, "A") == [("ash", 9, 3, 3, 2, 3, 2, 3.0, 2.0), ("oak", 5, 8, 5, 1, 7, 8, 6.0, 4.5)]
    assert rows(reshape.pivot_table(pivot6, ["A"], "B", {"C": "max"}), "A") == [("ash", 9, 3), ("oak", 4, 6)]


def test_dtypes(spark):
    df = spark.createDataFrame([(6, 0.3, "one", True)], "A long, B double, C string, D boolean")
    assert select.select_dtypes(df, include=["bool", "int64"]).columns == ["A", "D"]
    assert select.select_dtypes(df, exclude=["bool", "int64"]).columns == ["B", "C"]


def test_describe(spark):
    data = [(1, "one", True), (2, "two", False), (3, "three", True), (4, "four", False), (5, "five", False)]
    df = spark.createDataFrame(data, "numb int, word string, bool boolean")
    got = stats.describe_numeric(df, ["numb"]).first()
    assert (got["count"], got["mean"], got["min"], got["max"]) == (5, 3.0, 1.0, 5.0)
    assert (got["q25"], got["q50"], got["q75"]) == (2.0, 3.0, 4.0) and got["std"] == pytest.approx(1.5811388)
    texts = {r["column"]: r for r in stats.describe_object(df, ["word", "bool"]).collect()}
    assert texts["word"]["unique"] == 5
    assert (texts["bool"]["unique"], texts["bool"]["top"], texts["bool"]["freq"]) == (2, "false", 3)


def test_categories(grid3):
    df = grid3.withColumn("cat", F.when(F.col("label") == "b", "I").otherwise("IV"))
    order = ["I", "II", "III", "IV", "V"]
    assert [r.label for r in groups.category_sort(df, "cat", order, ["label"]).collect()] == ["b", "a", "c"]
    sizes = dict(rows(groups.category_size(df, "cat", order)))
    assert sizes == {"I": 1, "II": 0, "III": 0, "IV": 2, "V": 0}


def test_concat_on_labels(spark):
    df = frames.frame(spark, [[i] * 4 for i in range(4)], ["A", "B", "C", "D"], list("abcd"))
    e = frames.series(spark, [7] * 5, list("acdef")).withColumnRenamed("value", "E")
    outer = {r[0]: r[1:] for r in rows(joins.concat_cols([df, e], "label"))}
    assert sorted(outer) == list("abcdef")
    assert outer["b"] == (1, 1, 1, 1, None) and outer["e"] == (None, None, None, None, 7)
    inner = joins.concat_cols([df, e], "label", "inner")
    assert [r[0] for r in rows(inner, "label")] == ["a", "c", "d"]
    again = joins.concat_cols([df, e, df], "label")
    assert again.columns == ["label", "A", "B", "C", "D", "E", "A_2", "B_2", "C_2", "D_2"]


def test_align(spark):
    left = frames.frame(spark, [[1] * 4] * 4, ["A", "B", "D", "E"], list("abcd"))
    right = frames.frame(spark, [[2] * 4] * 4, ["A", "C", "D", "E"], list("bcde"))
    for join, labels, columns in (("outer", "abcde", "ABCDE"), ("inner", "bcd", "ADE")):
        for one in labelled.align(left, right, "label", join):
            assert one.columns == ["label", *columns]
            assert [r[0] for r in rows(one, "label")] == list(labels)
    mirrored = labelled.align(right, left, "label")
    assert rows(mirrored[1], "label") == rows(labelled.align(left, right, "label")[0], "label")
    with pytest.raises(ValueError, match="labels"):
        labelled.compare_same(left, right.toDF("label", "A", "B", "D", "E"), "gt", "label")


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    b = spark.createDataFrame([(None, 3), (2, 4)], "k int, v int")
    got = {how: sorted(rows(joins.merge(a, b, "k", how)), key=str) for how in ("inner", "left", "right", "outer")}
    assert got["inner"] == [(None, 1, 3)]
    assert got["left"] == [(1, 2, None), (None, 1, 3)]
    assert got["right"] == [(2, None, 4), (None, 1, 3)]
    assert got["outer"] == [(1, 2, None), (2, None, 4), (None, 1, 3)]


def test_tidy(spark):
    data = [[5, 8, 13], [21, 3, 1], [7, 2, 40], [11, 6, 9]]
    names = ["oak", "elm", "ash"]
    df = frames.frame(spark, data, names, ["south", "east", "north", "west"], "side")
    long = reshape.melt(df, ["side"], names, "tree", "stems")
    assert long.count() == 12 and long.agg(F.sum("stems")).first()[0] == 126
    stacked = reshape.stack(df, ["side"], names, "tree", "stems")
    assert rows(stacked, "side", "tree") == rows(long, "side", "tree")
    back = reshape.unstack(stacked, ["side"], "tree", "stems", names)
    assert rows(back, "side") == rows(df, "side")
    with pytest.raises(ValueError, match="more than once"):
        reshape.unstack(long.unionByName(long), ["side"], "tree", "stems")
    with pytest.raises(ValueError, match="not in the list"):
        reshape.unstack(stacked, ["side"], "tree", "stems", names[:2])
    turned = reshape.transpose(df, "side", names, kind="long")
    assert turned.columns == ["column", "east", "north", "south", "west"]
    assert rows(turned, "column")[2] == ("oak", 21, 7, 5, 11)


def test_message(spark):
    told = ["3 love", "6 data", "2 x", "1 I", "4 y", "5 z"]
    data = [("m", i, t) for i, t in enumerate(told)] + [("n", i, t) for i, t in enumerate(told) if i]
    lines = spark.createDataFrame(data + [("o", 0, "2 no")], "m string, n int, t string")
    assert rows(X.decode_messages(lines, "m", "n", "t"), "m") == [("m", "I love data"), ("n", "I"), ("o", "")]
    cut = spark.createDataFrame([("m", i, t) for i, t in enumerate(told) if t != "3 love"], "m string, n int, t string")
    assert rows(X.decode_messages(cut, "m", "n", "t")) == [("m", "I")]


def test_interpolation_modes(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "i int, x double")
    line = Line.of(df, (), "i")
    assert [r[1] for r in rows(clean.interpolate(line, ["x"]).result(), "i")] == [None, 1, 2, 3, 3]
    assert [r[1] for r in rows(clean.interpolate(line, ["x"], "inside").result(), "i")] == [None, 1, 2, 3, None]


def test_budget(spark):
    offers = spark.createDataFrame([("p", "A", 0.9, 30.0), ("p", "B", 0.8, 40.0), ("p", "C", 0.7, 15.0)], "k string, t string, p double, price double")
    got = rows(decide.budget_allocate(offers, ["k"], "t", "p", "price"))
    assert got == [("p", "A", 0.9, 30.0, 3, 90.0)]
    cheap = spark.createDataFrame([("p", "A", 0.9, 0.1)], "k string, t string, p double, price double")
    assert rows(decide.budget_allocate(cheap, ["k"], "t", "p", "price"))[0][4] == 100 // 0.1


def test_verdicts(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate([0.6, 0.5, 0.1, 0.0, -0.1, -0.5, -0.6])], "i int, k double")
    got = [r[0] for r in rows(df.orderBy("i").select(decide.verdict(F.col("k"))))]
    assert got == ["Strong Buy", "Buy", "Hold/Neutral", "Hold/Neutral", "Hold/Neutral", "Sell", "Strong Sell"]


def test_html(spark):
    page = (
        "<table><tr><th>Month</th><th>Jan</th></tr><tr><th>Daily mean</th><td>7.5 (45.5)</td></tr>"
        "<tr><th>Record low</th><td>−11.0 (12.2)</td></tr></table><ul><li>one<li>two</ul>"
    )
    pages = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    cells = html.html_cells(pages, "id", "html")
    assert cells.count() == 6
    wide = html.table_wide(html.tables_matching(cells, "id", "Month"), "id", 0, ["Month", "Jan"])
    got = {r.Month: r.v for r in wide.select("Month", X.measure(F.col("Jan")).alias("v")).collect()}
    assert got == {"Daily mean": 7.5, "Record low": -11.0}
    assert [r.text for r in html.html_cells(pages, "id", "html", "list").orderBy("row_no").collect()] == ["one", "two"]


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("name,pop,area\nA,1,Not Known\nNot Known,2,3.5\nC,,4\n")
    path = str(tmp_path / "c.csv")
    got = files.scan_csv(spark, path, "name string, pop long, area double", na_values=["Not Known"])
    assert rows(got, F.asc_nulls_last("name")) == [("A", 1, None), ("C", None, 4.0), (None, 2, 3.5)]
    assert files.scan_csv(spark, path, nrows=2, columns=["name"]).count() == 2
    raw = files.scan_csv(spark, path, na_values=["Not Known"], na_filter=False)
    assert sorted(r.pop for r in raw.collect()) == ["", "1", "2"]
    assert files.scan_csv(spark, path, header=False).count() == 4


def test_cache_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3).withColumn("part", F.col("id") % 2)

    path = str(tmp_path / "cache")
    for force in (False, False, True):
        assert files.cached(spark, path, build, ["part"], force).count() == 3
    assert len(built) == 2


def test_text_rules(spark):
    df = spark.createDataFrame([("AB12",), ("12",), ("",), (None,)], "t string")
    t = F.col("t")
    got = rows(df.select(X.extract(t, "([0-9]+)"), X.isdigit(t), X.isalnum(t), X.find(t, "1"), X.cat(t, t, "-")))
    assert got == [("12", False, True, 2, "AB12-AB12"), ("12", True, True, 0, "12-12"), (None, False, False, -1, "-"), (None,) * 5]


def test_fill_and_flex(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", None, 2.0)], "k string, n int, x double")
    assert rows(clean.fillna(df, "Empty", ["n", "x"]), "k") == [("a", "1", "Empty"), ("b", "Empty", "2.0")]
    assert rows(clean.nan_to_null(df.withColumn("x", F.coalesce("x", F.lit(float("nan"))))), "k")[0][2] is None
    flipped = labelled.binary(df.fillna(0), 2, "rsub", "k")
    assert rows(flipped, "k") == [("a", 1, 2.0), ("b", 2, 0.0)]
    zero = labelled.binary(df.fillna(0), 2, "rdiv", "k")
    assert rows(zero, "k")[0][2] is None


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(5.0,), (-5.0,), (None,)], "x double")
    assert [r[0] for r in rows(df.select(filters.clip(F.col("x"), -1.0, 1.0)))] == [1.0, -1.0, None]


def test_null_labels_find_each_other(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    side = spark.createDataFrame([(None, 7), ("a", 8)], "k string, w int")
    got = select.assign_series(df, "k", side, "x", "w")
    assert sorted(rows(got), key=str) == [("a", 2, 8), ("b", 3, None), (None, 1, 7)]
    wanted = spark.createDataFrame([(None,), ("z",)], "k string")
    assert sorted(rows(labelled.reindex_rows(df, "k", wanted)), key=str) == [("z", None), (None, 1)]


def test_several_operations_from_one_join(spark):
    a = spark.createDataFrame([(1, 6.0), (2, 8.0)], "k int, v double")
    b = spark.createDataFrame([(2, 4.0), (3, 5.0)], "k int, v double")
    got = labelled.binary_many(a, b, [("v", "sub", None), ("v", "rdiv", 1)], "k")
    assert rows(got, "k") == [(1, None, 1 / 6), (2, 4.0, 0.5), (3, None, 5.0)]
    left, right = labelled.align(a, b, "k")
    long = labelled.align_long(a, b, "k")
    for side, df in (("left", left), ("right", right)):
        assert rows(long.filter(F.col("side") == side).drop("side"), "k") == rows(df, "k")


def test_first_rows_of_files(spark, tmp_path):
    for i, n in enumerate((3, 40, 2)):
        lines = ["a,b", *[f"{i}{j:02},{'' if j else 'NA'}" for j in range(n)]]
        (tmp_path / f"part-{i}.csv").write_text("\n".join(lines) + "\n")
    got = files.scan_csv(spark, str(tmp_path), "a string, b string", na_values=["NA"], nrows=5)
    assert rows(got, "a") == [("000", None), ("001", None), ("002", None), ("100", None), ("101", None)]
    raw = files.scan_csv(spark, str(tmp_path), "a string, b string", columns=["b"], na_values=["NA"], na_filter=False, nrows=2)
    assert rows(raw, "b") == [("",), ("NA",)]


def test_long_tail_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 9 > 0, "hot").alias("k"), F.col("id").alias("t"))
    got = rows(S.tail_per_key(df, ["k"], ["t"], 3), "k", "t")
    assert got == [(None, 4977), (None, 4986), (None, 4995), ("hot", 4997), ("hot", 4998), ("hot", 4999)]


def test_regimes_of_each_series(spark):
    calm, wild = [0.01, -0.012, 0.009, -0.011] * 15, [0.3, -0.35, 0.28, -0.31] * 15
    data = [(k, i, x * scale) for k, scale in (("a", 1.0), (None, 0.01)) for i, x in enumerate(calm + wild)]
    data += [("flat", i, 0.0) for i in range(30)]
    df = spark.createDataFrame(data, "k string, t int, log_ret double")
    got = [
        rows(paths.vol_regime_per_key(Line.of(df, "k", "t", limit), use_rolling_vol=True).select("k", "t", "regime"), "k", "t")
        for limit in (None, 20)
    ]
    assert got[0] == got[1]
    regime = {(k, t): x for k, t, x in got[0]}
    assert [regime["a", t] for t in (20, 50, 70, 110)] == [0, 0, 1, 1]
    assert [regime["flat", t] for t in (10, 25)] == [0, 0]
    empty = paths.vol_regime_per_key(Line.of(df.limit(0), "k", "t"))
    assert empty.count() == 0
