import math

import pytest
from pyspark.sql import functions as F

from loomline.ml import classify
from loomline.operators import chain, reports, selectors


def test_selectors_choose_and_project(spark):
    df = spark.createDataFrame([(i, float(i), 1.0, float(i % 7), i % 2) for i in range(200)], "k int, a double, one double, b double, y int")
    cols = ["a", "one", "b"]
    chosen = selectors.create("variance")(df, cols)
    assert chosen.columns == ("a", "b")
    assert chosen.transform(df.drop("y"), ["k"]).columns == ["k", "a", "b"]
    with pytest.raises(ValueError, match="unexpected"):
        chosen.transform(df, ["k"])
    with pytest.raises(ValueError, match="missing"):
        chosen.transform(df.drop("a", "y"), ["k"])
    with pytest.raises(ValueError, match="no selector"):
        selectors.create("magic")
    with pytest.raises(ValueError, match="cannot choose"):
        selectors.create("anova")(df, cols, "y", 4)
    assert set(selectors.create("anova")(df, cols, "y", 2).columns) == {"a", "b"}
    assert selectors.create("correlation")(df.withColumn("c", F.col("a") * 2), ["a", "c", "b"]).columns == ("a", "b")


@pytest.mark.parametrize(("f", "d1", "d2"), [(0.0, 2, 10), (0.3, 1, 5), (1.0, 4, 4), (3.7, 2, 30), (12.5, 3, 200), (250.0, 1, 1000)])
def test_tail_of_f_is_the_integral(f, d1, d2):
    """Against the density in x = d1 f / (d1 f + d2), by the midpoint rule after smoothing its ends."""
    a, b = d1 / 2, d2 / 2
    x = d1 * f / (d1 * f + d2)
    n = 200_000
    # with x = sin(t)^2 the ends are smooth for all shapes of 1/2 and more
    lo, hi = math.asin(math.sqrt(x)), math.pi / 2
    h = (hi - lo) / n
    total = sum(2 * math.sin(t) ** (2 * a - 1) * math.cos(t) ** (2 * b - 1) for t in (lo + (i + 0.5) * h for i in range(n))) * h
    want = total / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    assert selectors.f_tail(f, d1, d2) == pytest.approx(want, abs=1e-8)


def test_columns_beside_each_other(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, 20), (1, 10)], "k int, b int")
    assert sorted(map(tuple, reports.beside(a, b, "k").collect())) == [(1, "x", 10), (2, "y", 20)]
    for bad in (b.filter("k = 1"), b.unionByName(b.filter("k = 2"))):
        with pytest.raises(Exception, match="no single partner for 2"):
            reports.beside(a, bad, "k").collect()


def test_order_by_rank_and_metadata(spark):
    df = spark.createDataFrame([("c",), ("a",), ("b",), ("z",)], "v string")
    assert [r.v for r in reports.by_rank(df, "v", ["b", "c"]).collect()] == ["b", "c", "a", "z"]
    assert reports.metadata(df, ["v"]).columns == ["v"]
    with pytest.raises(ValueError, match="missing"):
        reports.metadata(df)


def test_label_situations():
    assert reports.label_situation(True, {"train": True, "test": True}, "y") == {"case": "A", "target": "y", "supervised_metrics_allowed": True}
    assert reports.label_situation(False, {"train": True, "test": True}, "y")["case"] == "C"
    assert reports.label_situation(True, {"train": True, "test": False}, "y") == {"case": "B", "target": None, "supervised_metrics_allowed": False}
    assert reports.label_situation(False, {}, None)["case"] == "B"


def test_accounting_finds_a_wrong_run(spark):
    runs = spark.createDataFrame([("a", 3, 2, 1, 0.5), ("a", 4, 2, 1, 0.5), ("b", 2, 1, 1, 1.0)], "s string, requests long, evaluated long, hits long, seconds double")
    assert {r.s: (r.runs, r.requests, r.consistent) for r in reports.search_accounting(runs, ["s"]).collect()} == {"a": (2, 7, False), "b": (1, 2, True)}


def test_quorum(spark):
    rows = spark.createDataFrame([([True] * 3,), ([True, False, True],), ([],), ([True, None],)], "v array<boolean>")
    assert [r.q for r in rows.select(chain.quorum(F.col("v")).alias("q")).collect()] == [True, False, False, False]


def test_model_is_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(80)], "k int, a double, y int")
    model = classify.train(df, ["a"], "y", "decision_tree")
    path = str(tmp_path / "m")
    classify.save(model, path, ["a"], spark)
    again, columns = classify.load(path, spark)
    assert columns == ["a"] and classify.predict(df, again, "k").collect() == classify.predict(df, model, "k").collect()
    spark.createDataFrame([("0", ["a"], 1)], "version string, columns array<string>, nodes int").write.mode("overwrite").json(f"{path}/metadata")
    with pytest.raises(ValueError, match="version 0"):
        classify.load(path, spark)


def test_quantiles_and_positions_by_group(spark):
    import random
    import statistics

    from loomline.operators import ranks

    rng = random.Random(4)
    rows = [(g, None if rng.random() < 0.05 else float(rng.choice((rng.randint(0, 9), rng.gauss(0, 100))))) for g in ("a", "b", None) for _ in range(300)]
    rows += [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q1, r.m) for r in ranks.quantiles(df, "v", [0.25, 0.5], ["q1", "m"], ["g"]).collect()}
    assert set(got) == {"a", "b", None, "one"} and got["one"] == (3.0, 3.0)
    for g in ("a", "b", None):
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == pytest.approx((statistics.quantiles(own, n=4, method="inclusive")[0], statistics.median(own)))
        before = {r.v: r.before for r in ranks.counted(df, "v", ["g"]).collect() if r.g == g}
        assert before == {v: own.index(v) for v in set(own)}
    whole = sorted(v for _, v in rows if v is not None)
    assert ranks.quantiles(df, "v", [0.5], ["m"]).first().m == pytest.approx(statistics.median(whole))
    assert ranks.quantiles(df.filter("g = 'none'"), "v", [0.5], ["m"]).first().m is None
