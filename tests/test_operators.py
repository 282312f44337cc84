"""Known values of single operators, metamorphic properties and plan shapes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.functions import dates, gstin, numbers, text
from bidlake.operators import anomaly, comparison, features, matching, ml, reliability, timeseries, validation
from bidlake.operators import purchase_orders as po
from bidlake.sources import files, scans, sinks
from bidlake.sources.driver import Tables
from bidlake.streaming import jobs


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_tax_split(spark):
    rows = [("a", 18, 1000.0, "27", "27"), ("b", 18, 1000.0, "27", "29"), ("c", 18, 1000.0, None, "27"), ("d", 0, 5.0, "27", "27")]
    df = spark.createDataFrame(rows, "po_id string, rate int, taxable double, buyer_state string, supplier_state string")
    got = {(r.po_id, r.name): (r.tax_rate, r.amount) for r in po.tax_split(df).collect()}
    assert got == {("a", "CGST"): (9.0, 90.0), ("a", "SGST"): (9.0, 90.0), ("b", "IGST"): (18.0, 180.0), ("c", "GST"): (18.0, 180.0)}


def test_delivery(spark):
    t = dt.datetime(2026, 1, 10, 8)
    rows = [(1, t + dt.timedelta(hours=5), t), (2, t + dt.timedelta(days=3), t), (3, t, None)]
    df = spark.createDataFrame(rows, "po_id int, delivered_at timestamp, expected timestamp")
    assert [(r.on_time, r.delay_days) for r in po.record_delivery(df).orderBy("po_id").collect()] == [(True, 0), (False, 3), (None, None)]


ORDERS = [
    (0, "A", "2020-01-01", "2020-01-05"), (1, "A", "2020-03-01", "2020-03-01"), (2, "A", "2020-06-01", "2020-06-20"),
    (3, "A", "2020-06-10", "2020-06-09"), (4, "B", "2020-02-01", "2020-02-01"),
]


def build_features(spark, orders):
    df = spark.createDataFrame([(i, s, a, d) for i, s, a, d in orders], "line_id int, supplier_key string, s string, d string")
    f = features.as_of_features(df.select("line_id", "supplier_key", F.to_date("s").alias("scheduled"), F.to_date("d").alias("delivered")))
    return {r.line_id: r for r in f.collect()}


def test_as_of_features(spark):
    f = build_features(spark, ORDERS)
    assert (f[0].prior_count, f[0].prior_on_time_rate) == (0, None)
    assert (f[1].prior_count, f[1].prior_on_time_rate, f[1].prior_mean_delay, f[1].recent_late_rate, f[1].days_since_previous) == (1, 0.0, 4.0, 1.0, 26)
    assert (f[2].prior_count, f[2].prior_on_time_rate, f[2].prior_mean_delay, f[2].days_since_previous) == (2, 0.5, 2.0, 62)
    assert f[3].prior_count == 2 and f[4].prior_count == 0


def test_features_do_not_leak(spark):
    later = [*ORDERS[:3], (3, "A", "2020-06-10", "2020-09-30"), ORDERS[4]]
    a, b = build_features(spark, ORDERS), build_features(spark, later)
    assert all(a[k] == b[k] for k in (0, 1, 2))


def test_price_ladder_and_forest(spark):
    history = [100.0 + i % 5 for i in range(25)]
    assert anomaly.assess(300.0, history)["status"] == "HIGH_ANOMALY"
    assert anomaly.assess(101.0, history)["status"] == "NORMAL"
    rng = np.random.default_rng(1)
    log = rng.lognormal(np.log(100), 0.1, 60)
    assert anomaly.assess(101.0, log)["status"] == "NORMAL" and anomaly.assess(260.0, log)["status"] == "HIGH_ANOMALY"
    assert anomaly.assess(100.0, history[:19]) is None
    assert anomaly.assess(150.0, [100.0] * 30)["status"] != "NORMAL"
    assert anomaly.assess(260.0, log) == anomaly.assess(260.0, log)
    rows = [(300.0, 102.0, 1.58, 5), (135.0, 100.0, None, 1), (160.0, 100.0, 0.0, 2), (100.0, None, None, 0), (None, 100.0, 1.0, 9)]
    df = spark.createDataFrame(rows, "unit_price double, mean double, stddev double, n int")
    got = [(r.status, r.method) for r in anomaly.ladder(df).collect()]
    assert got == [("HIGH_ANOMALY", "z_score"), ("POSSIBLE_ANOMALY", "ratio"), ("HIGH_ANOMALY", "ratio"), ("INSUFFICIENT_DATA", "none"), ("INSUFFICIENT_DATA", "none")]


def test_monthly_series_and_forecast(spark):
    df = spark.createDataFrame([("x", dt.date(2024, 1, 15), 10.0), ("x", dt.date(2024, 3, 2), 5.0)], "item string, d date, q double")
    assert [(str(r.month), r.quantity) for r in timeseries.monthly_series(df, "item", "d", "q").orderBy("month").collect()] == [("2024-01-01", 10.0), ("2024-02-01", 0.0), ("2024-03-01", 5.0)]
    months = [dt.date(2021 + k // 12, 1 + k % 12, 1) for k in range(36)]
    series = spark.createDataFrame([("y", m, 100.0 + 50.0 * (m.month in (6, 7, 8))) for m in months] + [("z", m, 1.0) for m in months[:11]], "item string, month date, quantity double")
    b = {r.item: r for r in timeseries.backtest(series).collect()}
    assert b["y"].method == "seasonal_naive" and b["z"].status == "insufficient_data"
    f = timeseries.forecast(series, 3).orderBy("month").collect()
    assert [(r.month, r.quantity) for r in f] == [("2024-01", 100.0), ("2024-02", 100.0), ("2024-03", 100.0)]
    with pytest.raises(ValueError):
        timeseries.forecast(series, 13)
    pairs = spark.createDataFrame([(0.0, 0.0), (10.0, 0.0)], "a double, b double")
    assert [r[0] for r in pairs.select(numbers.smape_term(F.col("a"), F.col("b"))).collect()] == [0.0, 200.0]


def test_text_normalisation():
    for same in ('2" PVC PIPE', "PVC PIPE - 2 INCH", "PVC पाइप 2 इंच", '2" PVC PIPE CLASS 2', "PVCPIPE-2INCH"):
        assert text.similarity_of("PVC Pipe 2 inch", same) >= 0.62, same
    for other in ("PVC Pipe 3 inch", "PVC Elbow 2 inch", "Solvent Cement 500ml", "GI Pipe 2 inch"):
        assert text.similarity_of("PVC Pipe 2 inch", other) < 0.86, other
    assert text.similarity_of(None, "x") == 0.0


def test_units(spark):
    df = spark.createDataFrame([(u,) for u in ("Nos", "PCS", "BOTTLE", "Btl", "नग", "kgs", "Ltr", "ML", "inch", '"', "dozen", "banana")], "u string")
    assert [r.x for r in df.select(text.normalize_unit(F.col("u")).alias("x")).collect()] == ["nos", "nos", "bottle", "bottle", "nos", "kg", "l", "ml", "inch", "inch", "dozen", None]


def test_gstin(spark):
    values = ["27AABCS1429B1ZQ", "27AAGCM4455K1Z8", "29ABCDE1234F2Z5", " 27aabcs1429b1zq ", "", None, "27AABCS1429B1Q", "AB1234567890123", "27AABCS1429B1XQ", "27AABCS1429B0ZQ"]
    df = spark.createDataFrame([(v,) for v in values], "g string")
    assert [r.v for r in df.select(gstin.is_valid_gstin(F.col("g")).alias("v")).collect()] == [True] * 4 + [False] * 6
    assert [r.s for r in df.select(gstin.state_name(F.col("g")).alias("s")).collect()][:3] == ["Maharashtra", "Maharashtra", "Karnataka"]


def test_dates_and_numbers(spark):
    df = spark.createDataFrame([(v,) for v in ("15/09/2026", "2026-09-15", "15 Sep 2026", "15-09-2026", "as per schedule", None)], "d string")
    assert [r.d for r in df.select(dates.parse_date(F.col("d")).alias("d")).collect()] == [dt.date(2026, 9, 15)] * 4 + [None] * 2
    n = spark.createDataFrame([(v,) for v in ("Rs. 1,200.50/-", "n/a", "12%", "₹ 7", "abc", None, "-3.9")], "n string")
    assert [r.a for r in n.select(numbers.coerce_number(F.col("n")).alias("a")).collect()] == [1200.5, None, 12.0, 7.0, None, None, -3.9]
    assert [r.a for r in n.select(numbers.coerce_int(F.col("n")).alias("a")).collect()] == [1200, None, 12, 7, None, None, -3]


def quotation(spark, items, total=None, date=None):
    schema = """items array<struct<original_name:string,quantity:double,unit_price:double,gst_percentage:double,total_price:double>>, supplier struct<name:string,email:string,gst_number:string>,
        quotation struct<date:string>, commercials struct<subtotal:double,tax_amount:double,tax_percentage:double,total_amount:double,transportation_cost:double,delivery_days:int,payment_days:int>"""
    return spark.createDataFrame([(items, ("S", None, None), (date,), (None, None, None, total, None, None, None))], schema)


@pytest.mark.parametrize("item, expected", [
    (("a", None, None, None, 29200.0), [("incomplete_item", "ERROR")]), (("a", 10.0, 5.0, None, 50.0), []), (("a", 10.0, None, None, None), [("incomplete_item", "WARNING")]),
    (("a", 10.0, 5.0, None, 99.0), [("line_total_mismatch", "WARNING")]),
])
def test_validation_lines(spark, item, expected):
    v = validation.validate(quotation(spark, [item], 100.0), F.lit("2026-01-01").cast("date")).first()
    assert [(i.code, i.severity) for i in v.issues] == expected


def test_validation_empty(spark):
    v = validation.validate(quotation(spark, None, None, "soon"), F.lit("2026-01-01").cast("date")).first()
    assert {i.code for i in v.issues} == {"no_items", "missing_total", "unparseable_date"} and v.needs_review


def test_comparison_fixture(spark):
    rows = [(1, "shree", 15011.0, 7, 30, 0.375, 1.0, 0, 0), (1, "apex", 8824.0, 30, 0, 0.375, 0.5, 0, 0)]
    df = spark.createDataFrame(rows, "request_id int, quotation_id string, landed double, delivery_days int, payment_days int, reliability double, coverage double, error_count int, warning_count int")
    got = {r.quotation_id: r for r in comparison.compare(df).collect()}
    assert [round(got["shree"][f"{k}_score"], 6) for k in comparison.WEIGHTS] == [0, 1, 1, 0.375, 1.0]
    assert [round(got["apex"][f"{k}_score"], 6) for k in comparison.WEIGHTS] == [1, 0, 0, 0.375, 0.7]
    assert got["apex"].rank == 1 and got["apex"].overall == pytest.approx(0.5262, abs=2e-4) and got["apex"].decisive is False
    assert sum(comparison.normal_weights({"price": -1, "x": 2}).values()) == pytest.approx(1)


def test_order_lines_and_guard(spark):
    items = spark.createDataFrame([("i1", 100.0), ("i2", 500.0)], "request_item_id string, quantity double")
    matches = spark.createDataFrame([("i1", "L1", 68.0)], "request_item_id string, line_id string, match_price double")
    quoted = spark.createDataFrame([("L1", "MS plate", 70.0, None, 18.0)], "line_id string, description string, unit_price double, tax double, header_tax double")
    assert [(r.amount, r.rate) for r in po.order_lines(items, matches, quoted).collect()] == [(6800.0, 18.0)]
    assert [r.request_item_id for r in po.unmatched_items(items, matches).collect()] == ["i2"]
    rows = spark.createDataFrame([(1, "Shree", [11450.0]), (1, "Apex Metals", [6800.0, 8824.0])], "request_id int, name string, amounts array<double>")
    messages = spark.createDataFrame([(1, 1, "Shree", "Please match 10,000."), (2, 1, "Shree", "apex metals is cheaper"), (3, 1, "Shree", "Others quote INR 6,800.00")], "message_id int, request_id int, recipient string, body string")
    assert sorted((r.message_id, r.names, r.states) for r in matching.guardrail(messages, rows).collect()) == [(2, True, False), (3, False, True)]


def test_policy(spark):
    flags = "has_rows compared recommended risk_done has_message negotiable message_approved has_order order_approved".split()
    rows = [(False,) * 9, (True, True, True, True, False, True, False, False, False), (True, True, True, True, True, True, True, True, True)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} boolean" for f in flags))
    assert [r.next for r in reliability.next_actions(df).collect()] == ["comparison", "negotiation,purchase_order", "finish"]


def test_tenants(spark):
    rows = spark.createDataFrame([("1", "a", "2026-01-01"), ("2", "b", "2026-01-02")], "organization_id string, id string, created_at string")
    view = scans.TenantView({"q": rows}, "1")
    assert [r.id for r in view.list("q", limit=10_000).collect()] == ["a"] and view.get("q", "b").count() == 0
    with pytest.raises(ValueError):
        scans.TenantView({}, "")


def test_sinks(spark):
    old = spark.createDataFrame([(1, "x", "s1"), (2, "y", "s2")], "id int, name string, supplier_id string")
    new = spark.createDataFrame([(1, None, None)], "id int, name string, supplier_id string")
    assert [tuple(r) for r in sinks.update(old, new, "id").orderBy("id").collect()] == [(1, "x", None), (2, "y", "s2")]
    a, b = sinks.insert(old, spark.createDataFrame([(2, "z", None), (3, "w", None)], old.schema), ["id"])
    assert [r.id for r in a.collect()] == [3] and [r.id for r in b.collect()] == [2]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Item;Qty\nप्लेट;10.0\n;\nBolt;2.5\n".encode())
    r = files.read_tables(spark, str(tmp_path)).first()
    assert r.header == ["Item", "Qty"] and r.rows == [["प्लेट", "10"], ["Bolt", "2.5"]]
    assert files.best_header([["Quotation", None], ["Item", "Qty", "Rate"], ["Bolt", "2", "3"]]) == 1


def test_ml_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.2, 0)], "p double, label int")
    m = ml.metrics(df, threshold=0.5).first()
    assert (m.tp, m.fp, m.tn, m.fn) == (2, 1, 1, 0) and m.roc_auc == pytest.approx(0.75)
    assert ml.best_threshold(df).first().threshold == 0.7


def test_model_end_to_end(spark, small):
    f = features.as_of_features(Tables(spark, small).deliveries.where("supplier_key <= 4"))
    late = (F.col("line_id") % 5 == 0).cast("int")
    rows = f.where("prior_count > 0").withColumn("label", late)
    train, test = ml.time_split(rows, 1998)
    model = ml.fit(train, ["prior_count", "prior_mean_delay"], [], ml.candidates()["logistic"])
    scored = ml.scored(model, test)
    assert scored.count() == test.count() and 0 <= scored.agg(F.avg("p")).first()[0] <= 1


def test_plans(spark, small):
    t = Tables(spark, small)
    plan = features.as_of_features(t.deliveries)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    scan = t.price_history.select("item")._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" not in scan and "p_brand" not in scan  # pruned


def test_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = jobs.price_state(stream.select(F.col("event_type").alias("item"), F.col("value").alias("unit_price"))).writeStream.outputMode("complete").format("memory").queryName("prices").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.item: (r.n, round(r.mean, 6)) for r in spark.table("prices").collect()}
    want = {r.event_type: (r.n, round(r.m, 6)) for r in events.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m")).collect()}
    assert got == want


def test_ingest_once(spark, tmp_path):
    sink = jobs.append_unseen(str(tmp_path / "out"))
    sink(spark.createDataFrame([("a",), ("a",), ("b",)], "reference string"), 0)
    sink(spark.createDataFrame([("b",), ("c",)], "reference string"), 1)
    assert sorted(r.reference for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
