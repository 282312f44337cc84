"""Extraction, records, corrections, guards and running sums on known values."""

import pytest
from pyspark.sql import functions as F

from bidlake.functions import text
from bidlake.operators import extraction, matching, ml, normalization, timeseries, workflow
from bidlake.sources import scans, sinks
from bidlake.streaming import jobs

TEXT = """Shree Ram Traders
GSTIN: 27abcde1234f1z5 Email: a.b@x.co.in
Quotation
Quotation No: QT/24-7 dated 5/3/24
S.No  Description  Qty  Rate  Amount
1 PVC Elbow 2 inch  10 nos 12.50 125.00
2) Class-2 pipe 6m  5  100 500
Sub Total 625.00
3. Odd line 1 2 3 4 5
-----------
GST @ 18% : Rs. 112.50
Freight: Rs 40
Net payable: ₹ 777.50
Delivery within 10 to 12 working days, 50% advance
valid for 30 days"""


def test_header_fields(spark):
    r = extraction.extract_header(spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id int, text string")).orderBy("id").collect()
    a = r[0].asDict()
    assert (a["name"], a["gst_number"], a["email"], a["reference"], a["quoted_on"], a["validity"], a["currency"]) == ("Shree Ram Traders", "27ABCDE1234F1Z5", "a.b@x.co.in", "QT/24-7", "5/3/24", "30 days", "INR")
    assert (a["subtotal"], a["total_amount"], a["tax_percentage"], a["tax_amount"], a["transportation_cost"]) == (625.0, 777.5, 18.0, 112.5, 40.0)
    assert (a["delivery_days"], a["payment_days"], a["payment_terms"]) == (12, 0, "50% advance")
    for other in r[1:]:
        assert all(v is None for k, v in other.asDict().items() if k != "id")


def test_text_items(spark):
    rows = extraction.text_items(spark.createDataFrame([(1, TEXT), (2, None), (3, "word\n\n")], "id int, text string")).orderBy("line").collect()
    assert [(r.original_name, r.quantity, r.unit, r.unit_price, r.gst_percentage, r.total_price) for r in rows] == [
        ("PVC Elbow 2 inch", 10.0, "nos", 12.5, None, 125.0), ("Class-2 pipe 6m", 5.0, None, 100.0, None, 500.0), ("Odd line", None, None, None, None, None),
    ]
    assert rows[2].attributes == {"_unparsed_numbers": "[1.0, 2.0, 3.0, 4.0, 5.0]", "_note": extraction.NOTE}


def test_table_items(spark):
    data = [(1, ["Sr", "Particulars", "Price/Unit", "Units", "UOM", "Make", "Make"], [["1", " Bolt ", "₹ 5", "1,000", "pcs", "A", "B"], ["", "Grand Total", "9", None, None, None, None], ["2", "Nut"]]), (2, ["a", "b"], [["x", "y"]]), (3, None, None)]
    rows = extraction.table_items(spark.createDataFrame(data, "id int, headers array<string>, rows array<array<string>>")).orderBy("line").collect()
    assert [(r.id, r.original_name, r.quantity, r.unit, r.unit_price) for r in rows] == [(1, "Bolt", 1000.0, "pcs", 5.0), (1, "Nut", None, None, None)]
    assert rows[0].attributes == {"Sr": "1", "Make": "B"}


def test_record_and_corrections(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "nothing here")], "quotation_id int, text string")
    whole = extraction.with_items(extraction.extract_header(df), extraction.text_items(df), "quotation_id")
    records = normalization.normalize(whole, "2024-01-01")
    d = {r.quotation_id: r.data for r in records.collect()}
    assert d[1].pricing.landed_total == 777.5 and d[1].pricing.computed_subtotal is None and d[1]["items"][0].line_id == "line-1"
    assert d[2].missing_fields == ["items", "pricing.subtotal", "pricing.total_amount", "pricing.tax", "delivery.delivery_days", "payment_terms.payment_days"]
    fix = spark.createDataFrame([(1, "pricing.total_amount", "800", 1), (1, "pricing.total_amount", "900", 2), (1, "items.1.quantity", "7", 1), (1, "items.9.quantity", "7", 1)], "quotation_id int, path string, value string, at int")
    bad = [(1, "pricing.subtotal", "abc", 3), (1, "pricing.totl", "1", 3), (9, "pricing.subtotal", "1", 3), (1, "pricing.transportation_cost", None, 4)]
    fix = fix.unionByName(spark.createDataFrame(bad, fix.schema))
    fixed, audit, refused = normalization.correct(records, fix, ["pricing.total_amount", "items.1.quantity", "items.9.quantity", "pricing.subtotal", "pricing.transportation_cost"])
    got = {r.quotation_id: r.data for r in fixed.collect()}
    assert got[1].pricing.landed_total == 900.0 and got[1]["items"][1].quantity == 7.0 and got[1]["items"][1].computed_total == 700.0 and got[2] == d[2]
    # every correction is a record, in its order, with the value that it replaced
    assert sorted((r.path, r.previous_value or "", r.new_value or "", r.corrected_at) for r in audit.collect()) == [
        ("items.1.quantity", "5.0", "7", 1), ("pricing.total_amount", "777.5", "800", 1), ("pricing.total_amount", "800.0", "900", 2), ("pricing.transportation_cost", "40.0", "", 4),
    ]
    assert sorted((r.quotation_id, r.path, r.reason) for r in refused.collect()) == [
        (1, "items.9.quantity", "no such place"), (1, "pricing.subtotal", "not a value of type double"), (1, "pricing.totl", "unknown field path"), (9, "pricing.subtotal", "unknown record"),
    ]
    with pytest.raises(ValueError):
        normalization.correct(records, fix, ["pricing.totl"])
    assert records.select(normalization.get_path("data", "items.0.unit").alias("u")).first().u == "nos"


def test_prompt_text_and_salvage(spark):
    t = "array<struct<name:string,page:int,headers:array<string>,rows:array<array<string>>>>"
    df = spark.createDataFrame([(" a ", [(None, 2, ["h", "i"], [["1", None]] * 201)]), ("", [])], f"raw string, tables {t}")
    one, two = [r[0] for r in df.select(workflow.prompt_text(F.col("raw"), F.col("tables"))).collect()]
    assert one.startswith("===== DOCUMENT TEXT =====\na\n\n===== TABLE: Table 1 (page 2) =====\nh | i\n" + "-" * 40 + "\n1 | \n") and one.count("1 | ") == 200 and two == ""
    bad = spark.createDataFrame([('{"supplier": {"name": "x"}, "items": [{"n": 1}, null]}',), ("no json",)], "c string")
    rows = bad.select(normalization.salvage(F.col("c"), "supplier struct<name:string>, items array<struct<n:int>>").alias("s")).collect()
    assert rows[0].s.supplier.name == "x" and len(rows[0].s["items"]) == 1


def test_cache_counts_and_clamp(spark):
    cache, runs = workflow.ResultCache(), []
    a, b = spark.range(1), spark.range(2)
    for version in (a, a, b):
        cache.get("spend", "1", version, lambda: runs.append(1))
    assert len(runs) == 2 and [timeseries.clamped_horizon(h) for h in (-1, 5, 99)] == [1, 5, 12]
    q = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (2, 3)], "request_id int, quotation_id int")
    assert [r.request_id for r in jobs.ready_requests(q).collect()] == [r.request_id for r in jobs.ready_requests(q, 3).collect()] == [2]


def test_blank_names(spark):
    items = spark.createDataFrame([(1, 1, "the", "pcs")], "request_id int, request_item_id int, name string, unit string")
    lines = spark.createDataFrame([(1, 1, 1, "", "pcs")], "request_id int, quotation_id int, line_id int, name string, unit string")
    assert matching.match_items(items, lines, blank_matches=False).first().method == "unmatched"


def test_running_sums(spark):
    df = spark.createDataFrame([(k / 10, k) for k in range(11)] + [(0.55, 3)], "p double, n int")
    up = {r.p: r.run_n for r in ml.running(df, "p", ["n"], False).collect()}
    down = {r.p: r.run_n for r in ml.running(df, "p", ["n"], True).collect()}
    rows = [(r.p, r.n) for r in df.collect()]
    assert up == {p: sum(n for q, n in rows if q <= p) for p, _ in rows} and down == {p: sum(n for q, n in rows if q >= p) for p, _ in rows}


def test_raw_update_and_numbers(spark):
    rows = spark.createDataFrame([(1, "a", [("x",)], "2020-01-01"), (2, "b", [], "2020-01-01")], "id int, name string, history array<struct<s:string>>, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    change = spark.createDataFrame([(1, "c")], "id int, name string")
    push = spark.createDataFrame([(2, 1, "y")], "id int, at int, s string")
    got = {r.id: r for r in sinks.raw_update(rows, change, "id", push).collect()}
    assert got[1].name == "c" and [h.s for h in got[2].history] == ["y"] and all(r.updated_at.year > 2020 for r in got.values())
    view = scans.TenantView({"suppliers": spark.createDataFrame([("1", 1, "Ab", 1), ("2", 2, "ab", 1)], "organization_id string, id int, name string, created_at int")}, "1")
    assert [r.id for r in view.name_search("suppliers", "AB").collect()] == [1]


def test_items_of_tables_else_text(spark):
    t = "array<struct<headers:array<string>,rows:array<array<string>>>>"
    text = "Item Qty Rate Amount\nPVC pipe 2 inch 10 12.50 125.00"
    rows = [
        (1, text, [(["x"], [["y"]]), (["Item", "Qty"], [["Bolt", "3"], ["Total", "3"]]), (["Item", "Qty"], [["Nut", "4"]])]),
        (2, text, [(["Item"], [["Sub Total"]])]), (3, text, None), (4, None, []),
    ]
    got = extraction.items(spark.createDataFrame(rows, f"id int, text string, tables {t}"), "id").collect()
    assert sorted((r.id, r.line, r.original_name, r.quantity) for r in got) == [(1, 0, "Bolt", 3.0), (1, 1, "Nut", 4.0), (2, 1, "PVC pipe 2 inch", 10.0), (3, 1, "PVC pipe 2 inch", 10.0)]


def test_gstin_and_spaces(spark):
    df = spark.createDataFrame([(1, "9927ABCDE1234F1Z5X"), (2, "GST:27abcde1234f1z5, Pune"), (3, "\ufeffq\u200bty 2\u00a0kg")], "id int, text string")
    got = {r.id: r for r in extraction.extract_header(df).collect()}
    assert got[1].gst_number is None and got[2].gst_number == "27ABCDE1234F1Z5"
    from bidlake.functions import text as fn

    assert df.where("id = 3").select(fn.normalize_spaces(F.col("text")).alias("t")).first().t == "qty 2 kg"


def test_recovery_takes_five_statuses(spark):
    every = ["UPLOADED", "QUEUED", "EXTRACTING", "AI_EXTRACTING", "NORMALIZING", "COMPLETED", "REQUIRES_REVIEW", "FAILED"]
    df = spark.createDataFrame([(s,) for s in every], "processing_status string")
    assert [r[0] for r in scans.pending(df).collect()] == every[:5] and workflow.NOT_COMPLETE == ("FAILED", *every[:5])


def test_header_reads_a_text_once(spark):
    df = spark.createDataFrame([(1, "Quotation\nAcme Tools 7\nTotal Amount: 5")], "id int, text string")
    plan = extraction.extract_header(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1  # spaces were made plain for each pattern


def test_header_fields_anywhere(spark):
    texts = {
        1: "x\ny\nz\n-1-\n\nNo name yet 1\n--- Page 1\n- Acme & Söhne",  # the name beyond the first lines
        2: "mail:a@b c.d+e@f-g.co.in, @x.y; Tel 0281-2345678 or +91-98765 43210",
        3: "Quote No: AB​-77\r\nGrand Total : ₹ 1,23,456.50 net total 9; TAXABLE VALUE - INR 100\nGST @ 18 % 12.50\nCarriage: 40",
        4: "Deliver 3 to 5 working days. credit 5 days; 45 DAYS from date of invoice, 30 % ADVANCE, Validity upto 20 days, ref: none",
    }
    got = {r.id: r for r in extraction.extract_header(spark.createDataFrame(list(texts.items()), "id int, text string")).collect()}
    assert got[1].name == "No name yet 1" and got[1].email is None
    assert (got[2].email, got[2].phone) == ("c.d+e@f-g.co.in", "0281-2345678")
    assert (got[3].reference, got[3].total_amount, got[3].subtotal, got[3].tax_percentage, got[3].tax_amount, got[3].transportation_cost, got[3].currency) == ("AB-77", 123456.5, 100.0, 18.0, 12.5, 40.0, "INR")
    assert (got[4].delivery_days, got[4].delivery_terms, got[4].payment_days, got[4].payment_terms, got[4].validity, got[4].reference) == (5, "Deliver 3 to 5 working days", 45, "30 % ADVANCE", "20 days", None)


def test_units_of_lines_are_looked_up_once(spark):
    df = spark.createDataFrame([(1, "1. PVC pipe 2 Kgs 3 4.5 13.50")], "quotation_id int, text string")
    rows = normalization.normalize(extraction.with_items(extraction.extract_header(df), extraction.text_items(df), "quotation_id"), "2024-03-10")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    spelling = "regexp_replace(lower(trim("
    assert plan.count(spelling) <= 2  # in both attempts of one look-up
    item = rows.first()["data"]["items"][0]
    assert (item.normalized_unit, item.normalized_quantity) == (item.unit and "kg", item.quantity)


def test_folding_of_plain_text(spark):
    for s in ('G.I. Pipe-2"', "a\tb\x0cc\x1fd_e", "10KGS 5x3 (M.S.)", "A/B – 2″"):
        wide = text.fold_text(s + " é").split(" ")
        assert text.fold_text(s) == " ".join(wide[:-1])


def test_refused_corrections_read_the_texts_once(spark, small):
    from bidlake import registry

    plan = registry.queries()["dom06_refused"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" Traders") == 2  # for the header and for the items, not again to know the records


def test_texts_are_read_in_one_pass(spark, small):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, "word\n\n")], "quotation_id int, text string")
    apart = extraction.with_items(extraction.extract_header(df), extraction.text_items(df), "quotation_id")
    assert sorted(map(str, extraction.read_texts(df).select(*apart.columns).collect())) == sorted(map(str, apart.collect()))
    from bidlake import registry

    for name in ("dom05_records", "dom06_corrections", "dom06_audit"):
        plan = registry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(" Traders") == 1, name  # were made and read twice, for the header and for the items


def test_records_look_for_no_more_than_is_asked(spark, small):
    from bidlake import registry

    plan = registry.queries()["dom05_records"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert extraction.PHONE not in plan and extraction.EMAIL in plan and "_fold_lines" not in plan


def test_only_corrected_records_are_audited(spark, small):
    from bidlake import registry

    for name in ("dom06_audit", "dom06_refused"):
        plan = registry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan[: plan.index(" Traders")], name  # all records were worked out


def test_names_fold_in_arrays(spark):
    df = spark.createDataFrame([(1, ["PVC Pipe 2 Kgs", None, "", "b a b"]), (2, None), (3, []), (4, ["PVC Pipe 2 Kgs"])], "id int, names array<string>")
    got = {r.id: r.f for r in df.select("id", normalization.fold_lines(F.col("names")).alias("f")).collect()}
    assert got[1].names == ["pvc pipe 2 kg", None, "", "b b"] and got[1].tokens == [["2", "kg", "pipe", "pvc"], None, [], ["b"]]
    assert (got[2].names, got[2].tokens, got[3].names, got[4].names) == (None, None, [], ["pvc pipe 2 kg"])


def test_lines_with_rare_breaks(spark):
    texts = ["a\r\nb\x0bc\x1cd e\n", "Bolt\tM8 x  5\tnos  1,0 2.50\t25 \x1e12) Nut - 3 4 5\n2 7 8\nİİİ Total 5 6"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert [r.l for r in df.orderBy("id").select(extraction.lines(F.col("text")).alias("l")).limit(1).collect()] == [["a", "b", "c", "d", "e", ""]]
    rows = extraction.text_items(df).orderBy("line").collect()
    assert [(r.line, r.original_name, r.quantity, r.unit, r.unit_price, r.total_price) for r in rows] == [
        (0, "Bolt M8 x", 5.0, "nos", 10.0, 25.0), (1, "Nut", 3.0, None, 4.0, 5.0), (3, "İİİ Total", None, None, None, None),
    ]
