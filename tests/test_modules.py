import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline import sources
from loomline.functions import scalar as S
from loomline.ml import classify, iforest, knn_mi, masks
from loomline.operators import attack, features, filters, metrics, quality, reshape, select, split, stats

SF = "/root/testdata/sf0.001"


def test_csv_round_trip_and_resolution(spark, tmp_path):
    rows = sources.synthetic_transactions(spark, 200)
    sources.write_csv(rows.coalesce(1), str(tmp_path / "w"))
    one = next((tmp_path / "w").glob("part-*.csv"))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_bytes(one.read_bytes())
    names = [f.name for f in sources.RAW_SCHEMA]
    assert sources.find_candidates(spark, str(folder), names) and sources.resolve(spark, [str(tmp_path / "none"), str(folder)], names)
    back = sources.load_or_generate(spark, [str(folder)], names, 5)
    assert back.count() == 200 and dict(back.dtypes)["quantity"] == "double"
    (folder / "b.csv").write_bytes(one.read_bytes())
    with pytest.raises(sources.Ambiguous):
        sources.resolve(spark, [str(folder)], names)
    assert sources.load_or_generate(spark, [str(tmp_path / "none")], names, 5).count() == 5
    (folder / "c.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        sources.read_orders_csv(spark, str(folder / "c.csv"))


def test_synthetic_rows_repeat(spark):
    a, b = (sources.synthetic_transactions(spark, 3000) for _ in "ab")
    assert sources.fingerprint(a) == sources.fingerprint(b) != sources.fingerprint(sources.synthetic_transactions(spark, 3000, seed=1))
    share = a.filter("known_anomaly > 0").count() / 3000
    assert 0.015 < share < 0.045 and a.filter("known_anomaly = 0 AND anomaly_type <> 'none'").count() == 0


def test_normalize(spark):
    raw = spark.createDataFrame([("1", "9", "4/1/2016 21:05", "x", "2"), (None, "9", "4/1/2016 21:05", "3", "2"), ("2", "9", "soon", "3", "2")], ["i", "o", "d", "q", "p"])
    names = dict.fromkeys([f.name for f in sources.RAW_SCHEMA], "o") | {"transaction_id": "i", "timestamp": "d", "quantity": "q", "unit_price": "p"}
    got = sources.normalize(raw, names).collect()
    assert len(got) == 1 and got[0].quantity is None and got[0].unit_price == 2.0 and got[0].timestamp == dt.datetime(2016, 4, 1, 21, 5)


def test_splits_are_pruned(spark, tmp_path):
    rows = split.hash_split(spark.range(500), "id")
    sources.write_splits(rows, str(tmp_path / "s"))
    dev = sources.dev_scope(spark, str(tmp_path / "s"))
    assert "PartitionFilters: [" in dev._jdf.queryExecution().toString() and {r.split for r in dev.select("split").distinct().collect()} == {"train", "validation"}


def test_cells_resume(spark, tmp_path):
    plan = reshape.matrix(spark, {"a": [1, 2], "b": ["x", "y"]})
    ran = []

    def run(cells):
        ran.append(cells.count())
        return cells.withColumn("v", F.col("a") * 2)

    path = str(tmp_path / "cells")
    assert sources.run_missing(plan.filter("a = 1"), path, ["a", "b"], run).count() == 2
    assert sources.run_missing(plan, path, ["a", "b"], run).count() == 4 and ran == [2, 2]


def test_json_cells_and_config(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"cell": i, "rows": [{"v": 1.5}, {"v": 2.5}]}, indent=1))
    rows = sources.json_cells(spark, str(tmp_path), "rows", "cell int, rows array<struct<v:double>>")
    assert sorted(map(tuple, rows.collect())) == [(0, 1.5), (0, 2.5), (1, 1.5), (1, 2.5)]
    assert sources.load_config('{"a": 1}') == {"a": 1}


def test_row_id(spark):
    rows = sources.with_row_id(spark.range(1000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1000))), ["k"]).collect()
    assert sorted(r.row_id for r in rows) == list(range(1000)) and all(r.row_id == r.k for r in rows)


def test_scalars(spark):
    df = spark.createDataFrame([("b", ["a", "b", "c"], "007", "nan", "2020-02-30T00:00:00Z")], "v string, l array<string>, i string, n string, t string")
    row = df.select(
        S.cyclic_next(F.col("v"), F.col("l"), 2).alias("next"), S.canonical_id("i").alias("id"), S.as_number("n").alias("n"), S.is_canonical_timestamp("t").alias("t"),
        S.set_jaccard(F.array(), F.array()).alias("j"), S.relative_loss(F.lit(0.0), F.lit(1.0)).alias("loss"), S.bounded_rate_count(F.lit(50), 0.05).alias("k"),
        S.min_max(F.lit(5.0), F.lit(1.0), F.lit(1.0)).alias("m"), S.canonical_json(b=F.lit(1), a=S.json_string(F.lit('x"'))).alias("json"),
    ).first()
    assert tuple(row) == ("a", None, None, False, 1.0, 0.0, 2, 0.0, '{"a":"x\\"","b":1}')


def test_forward_fill_over_empty_spans(spark):
    rows = spark.createDataFrame([(1, None), (5, "a"), (700, None), (2000, None), (2001, "b"), (9000, None)], "o long, v string")
    got = {r.o: r.v for r in quality.forward_fill(rows, "o", ["v"], span=100).collect()}
    assert got == {1: None, 5: "a", 700: "a", 2000: "a", 2001: "b", 9000: "b"}


def test_leakage_rules(spark):
    df = spark.createDataFrame([(i, "x", i % 2) for i in range(40)], "order_id int, order_status string, flag int")
    reasons = {(r.column_name, r.reason) for r in quality.leakage_candidates(df).collect()}
    assert {("order_id", "identifier column"), ("order_status", "outcome column"), ("order_id", "nearly unique")} <= reasons
    with pytest.raises(ValueError):
        quality.forbid_columns(df, ["order_id"])
    nested = df.select(F.struct(F.struct("flag").alias("energy_j")).alias("a"))
    assert quality.forbidden_fields(nested, ["energy"]) == ["a.energy_j"]
    assert "| flag | int | numeric | 0 | 2 |" in sources.data_dictionary(df)
    dates = spark.createDataFrame([("4/1/2016 21:05", "no"), ("5/1/2016 1:05", "no")], "order_date string, update_date string")
    assert quality.potential_datetime_columns(dates) == ["order_date"]


def test_group_split_keeps_groups(spark):
    rows = split.greedy_group_split(spark.range(2000).withColumn("g", F.floor(F.col("id") / 7)), "g")
    assert rows.count() == 2000 and rows.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert 0.68 < rows.filter("split = 'train'").count() / 2000 < 0.72


def test_alignment_fails_closed(spark):
    a, b = spark.range(3).withColumnRenamed("id", "k"), spark.range(4).withColumnRenamed("id", "k")
    assert metrics.align(a, a, "k").count() == 3
    with pytest.raises(Exception, match="no partner for 3"):
        metrics.align(a, b, "k").collect()


def test_restore_refuses_other_values(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k long, total double")
    m = attack.attack_manifest(rows, "k", attack.SCENARIOS["value_manipulation"], "HIGH", 1.0)
    attacked = attack.apply_manifest(rows, m, "k", ("total",))
    assert attack.restore(attacked, m, "k", ("total",)).orderBy("k").collect() == rows.collect()
    with pytest.raises(Exception, match="not the one"):
        attack.restore(rows, m, "k", ("total",)).collect()


def test_skyline_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(int(g), int(i), float(a), float(b)) for i, (g, a, b) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 40, 200), rng.integers(0, 40, 200), strict=True))]
    got = {r.k for r in select.skyline(spark.createDataFrame(pts, "g int, k int, x double, y double"), ["g"], ["x"], ["y"]).collect()}
    want = {p[1] for p in pts if not any(q[0] == p[0] and q[2] >= p[2] and q[3] <= p[3] and (q[2] > p[2] or q[3] < p[3]) for q in pts)}
    assert got == want


def test_affine_needs_two_values(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "raw double, z double")
    with pytest.raises(Exception, match="no line"):
        features.apply_affine(rows.withColumn("c", F.lit(True)), features.fit_affine(rows, "raw", "z"), "raw", "z", "c").collect()


def test_interval_is_null_without_five_pairs(spark):
    rows = spark.createDataFrame([("a", 1.0)] * 4 + [("b", 1.0), ("b", 2.0), ("b", 3.0), ("b", 4.0), ("b", 5.0)], "c string, difference double")
    got = {r.c: r for r in stats.paired_interval(rows, ["c"]).collect()}
    assert got["a"].ci_low is None and got["b"].ci_low == pytest.approx(3 - 2.776445 * math.sqrt(2.5) / math.sqrt(5), abs=1e-4)


def test_greedy_filters(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    rows = [(float(a), float(a + 0.01 * b), float(b), 1.0) for a, b in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    kept, dropped = filters.correlation_filter(df, ["a", "b", "c", "k"])
    assert kept == ["a", "c", "k"] and dropped[0][:2] == ("b", "a")
    ranked = filters.redundancy_ranking(df, ["a", "b", "c", "k"])
    assert ranked[0] == "k" and set(ranked) == set("abck") and filters.nested_subsets(ranked)[0.5] == ranked[:2]


def test_isolation_forest(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(800, 2)))] + [(900, 9.0, 9.0), (901, -8.0, 7.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    scores = iforest.score(df, iforest.fit(df, ["a", "b"], "k"), "k").orderBy(F.desc("score")).collect()
    assert {r.k for r in scores[:2]} == {900, 901} and scores[0].flag == 1 and scores[-1].score < 0.5


def test_classifiers_separate(spark):
    rows = [(i, float(i % 20), float(i % 20 > 12)) for i in range(800)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    models = [classify.train(df, ["x"], "y", kind) for kind in classify.KINDS]
    for m in models:
        assert classify.predict(df, m, "k").join(df, "k").filter("flag = y").count() >= 760 and classify.complexity(m)
    assert classify.ensemble(df, models, "k").filter("n = 3").count() == 800


def test_searches_find_the_best_mask():
    best = (1, 0, 1, 1, 0, 0, 0, 1)

    def make():
        return masks.Cached(lambda ms: [-float(sum(a != b for a, b in zip(m, best, strict=True))) for m in ms])

    for how in (masks.bpso, masks.bgwo, masks.hybrid):
        found = how(make(), 8, 1)
        assert found.value >= -1 and found.evaluated <= found.requests and found.history == sorted(found.history) or how is masks.hybrid
        assert how(make(), 8, 1).mask == found.mask
    assert masks.mean_hamming([(0, 0), (1, 1)]) == 1.0


def test_knn_mutual_information(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 1500)
    rows = [(i, int(c), float(c * 4 + a), float(b)) for i, (c, a, b) in enumerate(zip(y, rng.normal(size=1500), rng.normal(size=1500), strict=True))]
    got = dict(knn_mi.knn_mi(spark.createDataFrame(rows, "k long, y int, near double, far double"), ["near", "far"], "y", "k"))
    assert 0.5 < got["near"] < 0.75 and got["far"] < 0.06


def test_streams(spark, tmp_path):
    from loomline import streaming

    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    for name, frame in (("w", streaming.window_stats(stream)), ("c", streaming.keyed_chain(stream, "user_id"))):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    chains = spark.table("c").toPandas()
    assert len(chains) == events.count() and chains.accepted.all()
    for _, part in chains.groupby("key"):
        part = part.sort_values("block_index")
        assert list(part.previous_hash[1:]) == list(part.block_hash[:-1])
    whole = {tuple(r) for r in streaming.window_stats(events).collect()}
    assert {tuple(r) for r in spark.table("w").collect()} <= whole


def test_locks_fail_closed(spark):
    from loomline.operators import locks

    df = spark.range(10)
    lock = locks.build("l", {"a": df}, {"k": 3})
    locks.verify(lock, {"a": df.orderBy(F.desc("id"))})
    for bad, frames in (({**lock, "parameters": {"k": 4}}, {"a": df}), (lock, {"a": spark.range(11)}), (lock, {})):
        with pytest.raises(locks.LockError):
            locks.verify(bad, frames)


def test_measurements(spark):
    from loomline.operators import measurement

    rows = [("wall_time", 1.0, "s", "measured", "training"), ("wall_time", 1.0, "ms", "measured", "training"), ("energy", None, "J", "unavailable", "inference"), ("energy", None, "J", "measured", "inference")]
    assert tuple(measurement.check(spark.createDataFrame(rows, measurement.SCHEMA)).first()) == (4, 2)


def test_storage_counts_canonical_bytes(spark):
    from loomline.operators import chain, experiments

    rows = [(str(5101 + i), "2016-04-01T21:05:00Z", "2016-04-03T00:00:00Z", "2016-04-05T00:00:00Z", "ab" * 32, "F", "0.50") for i in range(9)]
    df = spark.createDataFrame(rows, "order_id string, created string, shipped string, delivered string, lines_digest string, delivery_status string, risk_score string")
    chains = chain.build_chains(df)
    got = experiments.storage(experiments.workloads(chains, [522], [2, 5])).orderBy("workload").collect()
    one = sum(len(r.x) for r in chains.limit(1).select(F.explode(F.transform("chain", chain.preimage)).alias("x")).collect())
    assert [(r.orders, r.blocks, r.bytes) for r in got] == [(2, 10, 2 * one), (5, 25, 5 * one)]


def test_json_strings_escape_as_json_does(spark):
    import json

    from loomline.functions.scalar import json_string

    texts = ["plain", 'a"b\\c', "tab\tline\nend\n", "\x01\x7f\b\f\r", "zwölf €", "😀 𝄞", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.j for r in rows.select("i", json_string("t").alias("j")).orderBy("i").collect()]
    assert got == [json.dumps(t) for t in texts]


def test_one_key_in_several_parts_stays_in_order():
    import pandas as pd

    from loomline.streaming import events

    class State:
        exists, kept = False, None

        def update(self, value):
            self.kept = value

    late, early = pd.Timestamp("2024-01-02"), pd.Timestamp("2024-01-01")
    parts = [pd.DataFrame({"ts": [late]}), pd.DataFrame({"ts": [early]})]
    (out,) = events.append_to_chain(("k",), iter(parts), State(), "ts")
    assert out.accepted.tolist() == [True, True] and out.ts.tolist() == [early, late]
