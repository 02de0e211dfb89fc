"""Edge cases of the library's operators: nulls, NaN, ties, one row, empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeframe.functions import columns as fx
from gaugeframe.operators import joins, matrix, profiles, search, series, stats
from gaugeframe.plans import verify
from gaugeframe.sources import tables
from gaugeframe.streaming import windows


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_profile_of_one_value_has_sd_0(spark):
    df = spark.createDataFrame([("g", 1.0, 5.0), ("g", 11.0, None)], "g string, x double, y double")
    assert rows(profiles.binned_profile(df, F.col("x"), "y", 10.0, ["g"])) == [("g", 0, 5.0, 0.0, 0.0, 1)]
    assert profiles.binned_profile(df.where("false"), F.col("x"), "y", 10.0, ["g"]).count() == 0


def test_bins_at_their_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (-1.0,), (12.0,)], "x double")
    assert rows(profiles.histogram(df, "x", 0.0, 10.0, 10)) == [(0, 1), (1, 1), (9, 1)]
    assert [r[0] for r in df.select(fx.digitize(F.col("x"), 0.0, 10.0, 10)).collect()] == [0, 1, 9, 0, 9]
    i = spark.createDataFrame([(0.0, 5.0, "a"), (5.0, 9.0, "b")], "lo double, hi double, n string")
    assert rows(profiles.in_intervals(spark.createDataFrame([(5.0,), (9.5,)], "x double"), i, "x", "lo", "hi", 2.0).select("x", "n")) == [(5.0, "a"), (5.0, "b")]


def test_crossings(spark):
    s = lambda k, ys: [(k, float(i), y) for i, y in enumerate(ys)]
    data = s("first", [1.0, 2.0]) + s("line", [0.0, 0.0, 1.0]) + s("never", [0.1, 0.2]) + s("gap", [0.0, None, 1.0]) + s("again", [0.0, 0.8, 0.0, 0.9])
    got = dict(rows(series.crossing(spark.createDataFrame(data, "k string, t double, y double"), ["k"], "t", "y", 0.5)))
    assert got == {"first": 0.0, "line": 1.5, "never": None, "gap": 1.0, "again": 0.625}


def test_runs_and_onsets(spark):
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, False, True, True, False])] + [("b", 0, False), ("c", 1, True), ("c", 3, True)], "k string, i long, f boolean")
    assert rows(series.longest_run(df, ["k"], "i", F.col("f"))) == [("a", 2, 0, 1), ("c", 2, 1, 3)]
    assert dict(rows(series.onset(df, ["k"], "i", F.col("f"), 2))) == {"a": 0, "b": None, "c": None}


def test_constant_series_have_no_scale(spark):
    df = spark.createDataFrame([("k", float(i), 3.0) for i in range(4)], "k string, t double, y double")
    assert {r.scaled for r in series.normalise(df, ["k"], "t", "y", 2).collect()} == {None}
    assert {r.z for r in matrix.row_zscores(df, "k", "y").collect()} == {0.0}
    assert [r.slope for r in series.gradient(df.limit(1), ["k"], "t", "y").collect()] == [None]


def test_interpolation_stays_inside(spark):
    df = spark.createDataFrame([("k", 0.0, 0.0), ("k", 2.0, 4.0), ("k", 3.0, None)], "k string, t double, y double")
    grid = spark.createDataFrame([("k", x) for x in (-1.0, 0.0, 1.0, 2.0, 3.0)], "k string, at double")
    assert rows(series.interpolate(df, ["k"], "t", "y", grid, "at").select("at", "y")) == [(-1.0, None), (0.0, 0.0), (1.0, 2.0), (2.0, 4.0), (3.0, None)]


def test_edges_with_and_without_support(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([1, 9, 1, 9, 1])] + [("b", 0, 1)], "k string, i long, n long")
    assert rows(profiles.trim_edges(df, ["k"], "i", F.col("n") > 5)) == [("a", 1, 9), ("a", 2, 1), ("a", 3, 9), ("b", 0, 1)]


def test_adjustments_keep_nulls_and_order(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.02), ("f", 3, 0.5), ("f", 4, None)], "f string, i long, p double")
    assert [r.q for r in stats.benjamini_hochberg(df, ["f"], "p", "i").orderBy("i").collect()] == [pytest.approx(0.03), pytest.approx(0.03), 0.5, None]
    assert [r.q for r in stats.holm(df, ["f"], "p", "i").orderBy("i").collect()] == [pytest.approx(0.03), pytest.approx(0.04), 0.5, None]


def test_lookups(spark):
    names = spark.createDataFrame([(1, "x", "old"), (2, "x", "y"), (3, "1", None)], "id long, symbol string, alias string")
    tokens = spark.createDataFrame([("x",), ("y",), ("1",), ("none",), (None,)], "t string")
    got = {r.t: (r.resolved, r.by) for r in joins.resolve_symbols(tokens, "t", names, "id", ["symbol", "alias"]).collect()}
    assert got == {"x": (1, 1), "y": (2, 2), "1": (1, 0), "none": (None, None), None: (None, None)}


def test_group_means_count_rows_without_values(spark):
    x = spark.createDataFrame([("r1", "f", 4.0)], "r string, f string, v double")
    labels = spark.createDataFrame([("r1", "A"), ("r2", "A"), ("r3", "B"), ("r4", None)], "r string, l string")
    assert rows(matrix.group_means(x, labels, "r", "f", "v", "l")) == [("A", "f", 2.0, 0.5), ("B", "f", 0.0, 0.0)]


def test_skyline_with_ties(spark):
    df = spark.createDataFrame([("g", 1, 5.0, 1.0), ("g", 2, 5.0, 1.0), ("g", 3, 1.0, 5.0), ("g", 4, 1.0, 1.0)], "g string, id long, a double, b double")
    assert [r.id for r in search.skyline(df, ["g"], ["a", "b"], "id").orderBy("id").collect()] == [1, 2, 3]


def test_shares_add_up(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n long")
    assert rows(search.largest_remainders(df, "k", "n", 10).select("k", "share")) == [("a", 4), ("b", 3), ("c", 3)]


def test_differences_go_both_ways(spark):
    a = spark.createDataFrame([(1, 1.25), (2, None), (3, 3.0)], "k long, v double")
    assert verify.keyed_difference(a, a, ["k"], "v").ok
    assert verify.keyed_difference(a, a.where("k < 3"), ["k"], "v").only_left == 1
    assert verify.keyed_difference(a.where("k < 3"), a, ["k"], "v").only_right == 1
    assert verify.keyed_difference(a, a.withColumn("v", F.coalesce("v", F.lit(0.0))), ["k"], "v").largest == float("inf")
    assert verify.decimals(a, "v") == 2 and verify.tolerance(a, "v") == 0.005
    b = a.withColumn("g", F.lit(1))
    assert verify.sorted_difference(b, b.orderBy(F.desc("v")), ["g"], "v").ok
    assert verify.reappearing(a, a.where("k = 2").select("k"), ["k"]).count() == 1


def test_sources(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("id\tx\n007\t1.5\n008\tNaN\n009\t\n")
    df = tables.read_delimited(spark, str(p), "id string, x double")
    assert rows(df) == [("007", 1.5), ("008", None), ("009", None)]
    assert tables.broken(df, tables.Contract(("id", "y"), ("id",), 3, {"id": ("007", "008")})) == ["column y is missing", "column id has other values"]
    assert tables.broken(df.union(df), tables.Contract(key=("id",))) == ["key id repeats"]
    new = spark.createDataFrame([("008", 8.0), ("010", 10.0)], "id string, x double")
    assert rows(tables.upsert(df, new, ["id"])) == [("007", 1.5), ("008", 8.0), ("009", None), ("010", 10.0)]
    assert rows(tables.fill_defaults(df, new, ["id"])) == [("008", 8.0), ("010", 10.0)]
    index = tables.manifest(spark, str(tmp_path)).collect()
    assert len(index) == 1 and index[0].bytes == p.stat().st_size
    assert tables.file_index(spark, str(tmp_path), r"([^/]+)\.tsv$", ["name"]).first().name == "t"
    x = spark.createDataFrame([("r", "b", 1.0), ("q", "a", 2.0), ("r", "a", 3.0)], "r string, c string, v double")
    tables.write_matrix(x, "r", "c", "v", str(tmp_path / "m"))
    assert rows(spark.read.parquet(str(tmp_path / "m/triples"))) == [(1, 1, 2.0), (2, 1, 3.0), (2, 2, 1.0)]


def test_functions(spark):
    df = spark.createDataFrame([(" TRUE ", "1,2;x", "3-10", 190.0), (None, None, "b", -180.0)], "a string, l string, n string, d double")
    got = df.select(fx.truthy(F.col("a")), fx.list_of_ints(F.col("l")), fx.wrap_degrees(F.col("d")), fx.number(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(True, [1, 2], -170.0, None), (False, [], -180.0, None)]
    assert [r.n for r in df.orderBy(*fx.natural_key(F.col("n"))).collect()] == ["3-10", "b"]
    p = spark.createDataFrame([(0.05,), (0.0001,), (0.2,), (None,)], "p double")
    assert [r[0] for r in p.select(fx.stars(F.col("p"))).collect()] == ["*", "****", "ns", None]
    assert [r[0] for r in p.select(fx.stars(F.col("p"), strict=True)).collect()] == ["ns", "***", "ns", None]
    sig = spark.createDataFrame([(["b", "a"],), (["a", "b", "a"],)], "x array<string>").select(fx.signature(F.col("x"))).distinct()
    assert sig.count() == 1


def test_streams_match_their_batch_forms(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    data = [(f"u{i % 3}", base + dt.timedelta(minutes=17 * i), i, float(i % 7)) for i in range(90)]
    df = spark.createDataFrame(data, "u string, ts timestamp, i long, v double")
    df.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(sdf, mode, name):
        q = sdf.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return rows(spark.table(name))

    for width, slide in (("4 hours", None), ("4 hours", "2 hours")):
        assert run(windows.fixed_bins(stream(), "ts", "u", "v", width, slide), "complete", f"bins{slide is None}") == rows(windows.fixed_bins(df, "ts", "u", "v", width, slide))
    assert run(windows.sessions(stream(), "ts", "u", "1 hour"), "complete", "runs") == rows(windows.sessions(df, "ts", "u", "1 hour"))
    one = df.withColumn("k", F.floor(F.col("i") / 3).cast("long"))
    want = dict(rows(series.onset(one, ["u"], "k", F.col("v") > 3, 3)))
    got = dict(run(windows.onset_stream(stream().withColumn("k", F.floor(F.col("i") / 3).cast("long")), "u", "k", F.col("v") > 3, 3), "append", "onsets"))
    assert got == {k: v for k, v in want.items() if v is not None}


def test_sorted_difference_as_row_by_row(spark):
    rng = random.Random(3)
    one = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1.0, 1.4, 7.0, float("nan")])) for _ in range(120)] + [("only", 1.0)]
    two = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1.0, 2.0, 7.0])) for _ in range(90)] + [("other", 1.0), ("other", 1.0)]
    a, b = (spark.createDataFrame(rows, "g string, v double") for rows in (one, two))
    place = F.row_number().over(Window.partitionBy("g").orderBy("v"))
    want = verify.keyed_difference(a.withColumn("p", place), b.withColumn("p", place), ["g", "p"], "v", allowed=0.5)
    got = verify.sorted_difference(a, b, ["g"], "v", allowed=0.5)
    assert (got.matched, got.only_left, got.only_right, got.over, str(got.largest)) == (want.matched, want.only_left, want.only_right, want.over, str(want.largest))


def test_sorted_difference_orders_no_group_in_one_task(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(verify, "keyed_difference", lambda *a, **k: seen.append(1))
    df = spark.createDataFrame([("a", 1.0)] * 5, "g string, v double")
    assert verify.sorted_difference(df, df, ["g"], "v").matched == 5 and not seen


def test_quantile_of_a_group_beyond_what_a_task_holds(spark):
    df = spark.range(stats.HELD + 51).select((F.col("id") % 1).alias("g"), (F.col("id") * 7 % 1009 / 3.0).alias("v"))
    found = stats.exact_quantile(df, ["g"], "v", 0.5, "m")
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.first()["m"] == df.agg(F.percentile("v", 0.5)).first()[0]
