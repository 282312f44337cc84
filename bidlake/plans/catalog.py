"""Queries by operator id. ``query(name, sql)`` registers a plan and, where SQL can express it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dates, gstin, numbers, text
from ..operators import aggregates as agg
from ..operators import anomaly, comparison, features, matching, ml, reliability, retrieval, timeseries, validation
from ..operators import purchase_orders as po
from ..sources import scans, sinks
from ..sources.driver import Tables, with_tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2024-01-30 12:00:00"


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[Tables], DataFrame]):
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, plan=plan: plan(Tables(spark, folder))) for name, plan in PLANS.items()}


PO, Q = with_tables("purchase_orders"), with_tables("quotations")
D, H, R = with_tables("deliveries"), with_tables("price_history"), with_tables("requests")


# --- aggregates -------------------------------------------------------------------------------------------------


@query("agg07_spend_by_supplier", PO + """SELECT supplier_id, round(sum(total), 2) AS spend, count(*) AS orders, count(on_time) AS delivered,
 count(*) FILTER (on_time) AS on_time, CASE WHEN count(on_time) > 0 THEN count(*) FILTER (on_time) / CAST(count(on_time) AS DOUBLE) END AS on_time_rate
 FROM purchase_orders WHERE status IN ('issued', 'delivered', 'closed') GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return agg.spend_by_supplier(t.purchase_orders)


@query("agg08_spend_by_month", PO + "SELECT strftime(created_at, '%Y-%m') AS month, round(sum(total), 2) AS spend FROM purchase_orders GROUP BY 1")
def _(t):
    return agg.spend_by_month(t.purchase_orders)


@query("agg09_spend_by_item", "SELECT p_name AS item, round(sum(l_extendedprice), 2) AS spend, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(t):
    lines = t.raw("lineitem").join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
    return agg.spend_by_item(lines.select(F.col("p_name").alias("item"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount")))


@query("agg10_savings", PO + """, quoted AS (SELECT request_id, max(landed) AS highest, count(*) AS n FROM quotations WHERE landed <> 0 GROUP BY 1 HAVING count(*) > 1)
 SELECT po_id, request_id, highest, total, highest - total AS saved FROM purchase_orders JOIN quoted USING (request_id)""")
def _(t):
    return agg.savings(t.purchase_orders, t.quotations)


@query("agg11_total_spend", PO + "SELECT round(sum(total), 2) AS spend, count(*) AS orders FROM purchase_orders")
def _(t):
    return agg.committed(t.purchase_orders).agg(F.round(F.sum("total"), 2).alias("spend"), F.count("*").alias("orders"))


@query("agg01_count_by_status", R + "SELECT status, count(*) AS n FROM requests GROUP BY 1")
def _(t):
    return agg.count_by(t.requests)


@query("agg02_price_stats", H + "SELECT item, round(avg(unit_price), 6) AS mean, round(stddev_samp(unit_price), 6) AS stddev, min(unit_price) AS low, max(unit_price) AS high, count(*) AS n FROM price_history GROUP BY 1")
def _(t):
    return agg.price_stats(t.price_history).withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query("agg03_daily_trend", f"""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS c FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 13 DAY GROUP BY 1),
 d AS (SELECT strftime(x, '%Y-%m-%d') AS day FROM generate_series(CAST(TIMESTAMP '{AS_OF}' - INTERVAL 13 DAY AS DATE)::TIMESTAMP, CAST(TIMESTAMP '{AS_OF}' AS DATE)::TIMESTAMP, INTERVAL 1 DAY) g(x))
 SELECT day, CAST(coalesce(c, 0) AS BIGINT) AS n FROM d LEFT JOIN c USING (day)""")
def _(t):
    return timeseries.daily_counts(t.raw("events"), "ts", AS_OF)


@query("agg04_total_amount", Q + "SELECT coalesce(round(sum(landed), 2), 0.0) AS total FROM quotations WHERE error_count = 0")
def _(t):
    return t.quotations.where("error_count = 0").agg(F.coalesce(F.round(F.sum("landed"), 2), F.lit(0.0)).alias("total"))


@query("agg05_dashboard", R + "SELECT count(*) AS total, count(*) FILTER (status IN ('open', 'comparing')) AS active, count(*) FILTER (status = 'closed') AS closed FROM requests")
def _(t):
    return agg.rollup_counts(t.requests)


@query("agg06_fingerprint", "SELECT count(*) AS n, max(o_orderdate) AS latest FROM orders")
def _(t):
    return agg.fingerprint(t.raw("orders"), "o_orderdate")


@query("agg13_taxable_by_rate", "SELECT l_orderkey AS po_id, l_tax AS rate, round(sum(l_extendedprice), 2) AS taxable FROM lineitem GROUP BY 1, 2")
def _(t):
    return po.taxable_by_rate(t.raw("lineitem").select(F.col("l_orderkey").alias("po_id"), F.col("l_tax").alias("rate"), F.col("l_extendedprice").alias("amount")))


@query("agg17_supplier_performance", PO + "SELECT supplier_id, count(*) AS delivered, count(*) FILTER (NOT on_time) AS late, CAST(max(coalesce(delay_days, 0)) AS INTEGER) AS worst_delay FROM purchase_orders WHERE status = 'delivered' GROUP BY 1")
def _(t):
    return agg.supplier_performance(t.purchase_orders)


@query("agg18_medians", D + "SELECT supplier_key, median(order_value) AS median_value, median(quantity) AS median_quantity FROM deliveries GROUP BY 1")
def _(t):
    return agg.median_by_supplier(t.deliveries)


@query("agg21_late_rate_by_year", D + "SELECT CAST(year(scheduled) AS INTEGER) AS year, count(*) AS n, avg(CAST(delivered > scheduled AS INTEGER)) AS late_rate FROM deliveries GROUP BY 1")
def _(t):
    return agg.late_rate_by_year(t.deliveries)


@query("agg22_distinct_texts", """WITH f AS (SELECT p_brand, p_name, min(p_partkey) AS seen FROM part GROUP BY 1, 2)
 SELECT p_brand, string_agg(p_name, ' ' ORDER BY seen) AS joined FROM f GROUP BY 1""")
def _(t):
    return agg.distinct_concat(t.raw("part"), "p_brand", "p_name", "p_partkey")


@query("agg27_filtered_count", R + "SELECT count(*) AS n FROM requests WHERE status = 'open' AND priority IN ('1-URGENT', '2-HIGH')")
def _(t):
    return scans.where_all(t.requests, {"status": "open", "priority": ["1-URGENT", "2-HIGH"], "buyer_id": None}).agg(F.count("*").alias("n"))


@query("agg29_price_evidence", H + """, w AS (SELECT p_name AS item, min(p_partkey) AS position FROM part GROUP BY 1 ORDER BY 2 LIMIT 10)
 SELECT item, round(avg(unit_price), 2) AS mean, min(unit_price) AS low, max(unit_price) AS high, count(*) AS n FROM price_history JOIN w USING (item) GROUP BY 1""")
def _(t):
    wanted = t.raw("part").groupBy(F.col("p_name").alias("item")).agg(F.min("p_partkey").alias("position"))
    return agg.price_evidence(wanted, t.price_history)


# --- joins ------------------------------------------------------------------------------------------------------


@query("join01_request_counts", with_tables("requests", "quotations") + """SELECT r.request_id, r.status, CAST(coalesce(n, 0) AS BIGINT) AS quotations FROM requests r
 LEFT JOIN (SELECT request_id, count(*) AS n FROM quotations GROUP BY 1) USING (request_id)""")
def _(t):
    return agg.request_counts(t.requests, t.quotations)


@query("join02_quotation_suppliers", with_tables("quotations", "suppliers") + "SELECT quotation_id, name, state_code, landed FROM quotations LEFT JOIN suppliers USING (supplier_id)")
def _(t):
    return t.quotations.join(t.suppliers, "supplier_id", "left").select("quotation_id", "name", "state_code", "landed")


@query("join03_order_lines", """WITH i AS (SELECT l_orderkey * 1000000 + l_suppkey AS k, l_partkey, sum(l_quantity) AS quantity, min(round(l_extendedprice * 100) / 100 / l_quantity) AS price, max(l_tax) AS tax FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)
 SELECT k AS po_id, p_name AS description, quantity, price AS unit_price, round(quantity * price, 2) AS amount FROM i JOIN part ON l_partkey = p_partkey WHERE l_partkey % 5 <> 0""")
def _(t):
    li = t.raw("lineitem").where("l_quantity > 0")
    key = F.col("l_orderkey") * 1000000 + F.col("l_suppkey")
    i = li.groupBy(key.alias("po_id"), F.col("l_partkey").alias("line_id")).agg(F.sum("l_quantity").alias("quantity"), F.min(F.round(F.col("l_extendedprice") * 100) / 100 / F.col("l_quantity")).alias("match_price"))
    items = i.select("po_id", "quantity", F.struct("po_id", "line_id").alias("request_item_id"))
    matches = i.where("line_id % 5 <> 0").select(F.struct("po_id", "line_id").alias("request_item_id"), "line_id", "match_price")
    p = t.raw("part")
    quoted = p.select(F.col("p_partkey").alias("line_id"), F.col("p_name").alias("description"), F.col("p_retailprice").alias("unit_price"), F.lit(None).cast("double").alias("tax"), F.lit(18.0).alias("header_tax"))
    lines = po.order_lines(items, matches, quoted)
    return lines.select(F.col("request_item_id.po_id").alias("po_id"), "description", "quantity", "unit_price", "amount")


@query("join04_unmatched_items", "SELECT DISTINCT l_orderkey AS request_item_id, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    items = t.raw("lineitem").select(F.col("l_orderkey").alias("request_item_id"), "l_partkey").distinct()
    return po.unmatched_items(items, t.raw("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("request_item_id")))


@query("join09_counts_for_page", Q + "SELECT supplier_id, count(*) AS quotations FROM quotations WHERE supplier_id IN (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 50) GROUP BY 1")
def _(t):
    page = t.suppliers.orderBy("supplier_id").limit(50)
    return agg.counts_for(page, t.quotations)


@query("join10_with_history", with_tables("suppliers", "deliveries") + "SELECT supplier_id, name, n FROM suppliers JOIN (SELECT supplier_key, count(*) AS n FROM deliveries GROUP BY 1) ON supplier_key = supplier_id")
def _(t):
    n = t.deliveries.groupBy(F.col("supplier_key").alias("supplier_id")).agg(F.count("*").alias("n"))
    return t.suppliers.select("supplier_id", "name").join(n, "supplier_id")


@query("join13_term_product", """WITH p AS (SELECT p_partkey, p_brand, p_size FROM part), w AS (SELECT p_brand, avg(p_size) AS w FROM part GROUP BY 1)
 SELECT p_partkey, round(sum(p_size * w), 6) AS score FROM p JOIN w USING (p_brand) GROUP BY 1""")
def _(t):
    p = t.raw("part")
    w = p.groupBy("p_brand").agg(F.avg("p_size").alias("w"))
    return p.join(w, "p_brand").groupBy("p_partkey").agg(F.round(F.sum(F.col("p_size") * F.col("w")), 6).alias("score"))


_FEATURES = D + """, h AS (SELECT o.supplier_key, o.line_id, o.scheduled, o.rn, d.delivered, d.line_id AS dl, CAST(d.delivered > d.scheduled AS INTEGER) AS late, greatest(date_diff('day', d.scheduled, d.delivered), 0) AS delay, d.scheduled AS ds
 FROM (SELECT *, row_number() OVER () AS rn FROM deliveries) o LEFT JOIN deliveries d ON d.supplier_key = o.supplier_key AND d.delivered < o.scheduled - 30),
 k AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY delivered DESC, dl DESC, ds DESC) AS k FROM h WHERE delivered IS NOT NULL),
 a AS (SELECT rn, count(*) AS n, sum(late) AS lates, sum(delay) AS delays, max(delivered) AS last, sum(late) FILTER (k <= 10) AS recent FROM k GROUP BY 1)
 SELECT o.supplier_key, o.line_id, o.scheduled, CAST(coalesce(n, 0) AS BIGINT) AS prior_count, (n - lates) / CAST(n AS DOUBLE) AS prior_on_time_rate, delays / CAST(n AS DOUBLE) AS prior_mean_delay,
 recent / CAST(least(n, 10) AS DOUBLE) AS recent_late_rate, CAST(date_diff('day', last, o.scheduled - 30) AS INTEGER) AS days_since_previous
 FROM (SELECT supplier_key, line_id, scheduled, rn FROM h GROUP BY ALL) o LEFT JOIN a USING (rn)"""


@query("join07_as_of_features", _FEATURES)
def _(t):
    return features.as_of_features(t.deliveries)


# --- windows, top-k, sets ---------------------------------------------------------------------------------------

_SCORED = Q + """, s AS (SELECT q.*, 1.0 * n_parts / sum(n_parts) OVER w AS coverage, CASE WHEN supplier_id % 4 <> 0 THEN (supplier_id % 10) / 10.0::DOUBLE END AS reliability,
 min(landed) OVER w AS lo, max(landed) OVER w AS hi, min(delivery_days) OVER w AS dlo, max(delivery_days) OVER w AS dhi, min(payment_days) OVER w AS plo, max(payment_days) OVER w AS phi FROM quotations q WINDOW w AS (PARTITION BY request_id)),
 c AS (SELECT request_id, quotation_id, landed, CASE WHEN landed IS NULL THEN 0.35::DOUBLE WHEN hi = lo THEN 1.0::DOUBLE ELSE 1 - (landed - lo) / (hi - lo) END AS price_score,
 CASE WHEN dhi = dlo THEN 1.0::DOUBLE ELSE 1 - (delivery_days - dlo)::DOUBLE / (dhi - dlo)::DOUBLE END AS delivery_score,
 CASE WHEN payment_days IS NULL THEN 0.35::DOUBLE WHEN phi = plo THEN 1.0::DOUBLE ELSE (payment_days - plo)::DOUBLE / (phi - plo)::DOUBLE END AS payment_score,
 coalesce(reliability, 0.35::DOUBLE) AS reliability_score, 0.6::DOUBLE * coverage::DOUBLE + 0.4::DOUBLE * greatest(0.0::DOUBLE, 1 - 0.25::DOUBLE * error_count - 0.05::DOUBLE * warning_count) AS other_score,
 (3 + (payment_days IS NOT NULL)::INT + (reliability IS NOT NULL)::INT) / 5.0::DOUBLE AS completeness FROM s),
 o AS (SELECT *, round(round(price_score * 0.4::DOUBLE, 4) + round(delivery_score * 0.2::DOUBLE, 4) + round(payment_score * 0.15::DOUBLE, 4) + round(reliability_score * 0.15::DOUBLE, 4) + round(other_score * 0.1::DOUBLE, 4), 4) AS overall FROM c),
 compared AS (SELECT *, row_number() OVER p AS rank, overall - lead(overall) OVER p AS gap FROM o WINDOW p AS (PARTITION BY request_id ORDER BY overall DESC, completeness DESC, landed ASC NULLS LAST, quotation_id)) """


def _rated(t: Tables) -> DataFrame:
    s = F.col("supplier_id")
    share = F.col("n_parts") / F.sum("n_parts").over(W.partitionBy("request_id"))
    return t.quotations.withColumns({"coverage": share, "reliability": F.when(s % 4 != 0, (s % 10) / 10.0)})


@query("dom08_comparison", _SCORED + """SELECT request_id, quotation_id, landed, price_score, delivery_score, payment_score, reliability_score, other_score, completeness, overall, CAST(rank AS INTEGER) AS rank,
 CASE WHEN rank = 1 THEN coalesce(gap >= 0.03::DOUBLE, TRUE) END AS decisive FROM compared""")
def _(t):
    return comparison.compare(_rated(t))


@query("dom17_negotiation", _SCORED + """SELECT request_id, quotation_id, landed * 0.95::DOUBLE AS target, concat_ws(',', CASE WHEN price_score < 0.5 THEN 'price' END, CASE WHEN delivery_score < 0.5 THEN 'delivery' END,
 CASE WHEN payment_score < 0.5 THEN 'payment' END, CASE WHEN reliability_score < 0.5 THEN 'reliability' END, CASE WHEN other_score < 0.5 THEN 'other' END) AS asks,
 (price_score < 0.5 OR delivery_score < 0.5 OR payment_score < 0.5 OR reliability_score < 0.5 OR other_score < 0.5) AS negotiable FROM compared""")
def _(t):
    return comparison.negotiation(comparison.compare(_rated(t)))


@query("dom09_explanation", _SCORED + """SELECT quotation_id, CAST(rank AS INTEGER) AS rank, array_to_string(list_transform(list_sort([{'key': -price_score * 0.4::DOUBLE, 'name': 'price'}, {'key': -delivery_score * 0.2::DOUBLE, 'name': 'delivery'},
 {'key': -payment_score * 0.15::DOUBLE, 'name': 'payment'}, {'key': -reliability_score * 0.15::DOUBLE, 'name': 'reliability'}, {'key': -other_score * 0.1::DOUBLE, 'name': 'other'}]), lambda x: x.name), ', ') AS strengths FROM compared""")
def _(t):
    return comparison.explanation(comparison.compare(_rated(t))).select("quotation_id", "rank", "strengths")


@query("win06_leave_one_out", H + """SELECT order_id, line, item, unit_price, count(*) OVER w - 1 AS others, round((sum(unit_price) OVER w - unit_price) / (count(*) OVER w - 1), 6) AS others_mean FROM price_history WINDOW w AS (PARTITION BY item)""")
def _(t):
    return anomaly.leave_one_out(t.price_history).select("order_id", "line", "item", "unit_price", "others", F.round("others_mean", 6).alias("others_mean"))


@query("win09_line_numbers", "SELECT p_name, 'line-' || row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS line_id, p_partkey FROM part")
def _(t):
    items = t.raw("part").groupBy("p_name").agg(F.array_sort(F.collect_list("p_partkey")).alias("keys"))
    return items.select("p_name", F.posexplode("keys").alias("i", "p_partkey")).select("p_name", F.concat(F.lit("line-"), F.col("i") + 1).alias("line_id"), "p_partkey")


@query("top01_page", R + "SELECT request_id, status FROM requests ORDER BY created_at DESC, request_id LIMIT 50 OFFSET 100")
def _(t):
    return t.requests.orderBy(F.desc("created_at"), "request_id").offset(100).limit(50).select("request_id", "status")


@query("top02_recent", R + "SELECT request_id, created_at FROM requests ORDER BY created_at DESC, request_id LIMIT 8")
def _(t):
    return t.requests.orderBy(F.desc("created_at"), "request_id").limit(8).select("request_id", "created_at")


@query("top05_extreme_prices", H + """, m AS (SELECT item, quantile_cont(unit_price, 0.5) AS med FROM price_history GROUP BY 1)
 SELECT item, unit_price, unit_price / med AS ratio FROM price_history JOIN m USING (item) ORDER BY abs(ln(unit_price / med)) DESC, item, unit_price LIMIT 10""")
def _(t):
    h = t.price_history
    m = h.groupBy("item").agg(F.percentile("unit_price", 0.5).alias("med"))
    ratio = F.col("unit_price") / F.col("med")
    return h.join(m, "item").select("item", "unit_price", ratio.alias("ratio")).orderBy(F.desc(F.abs(F.ln("ratio"))), "item", "unit_price").limit(10)


@query("src08_newest_prices", H + """SELECT item, order_id, line, unit_price FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY created_at DESC, order_id, line, unit_price, supplier_id) AS k FROM price_history) WHERE k <= 1000""")
def _(t):
    ranked = t.price_history.withColumn("place", F.struct("order_id", "line", "unit_price", "supplier_id"))
    return scans.newest_per(ranked, "item", "created_at", anomaly.NEWEST_PRICES, "place").select("item", "order_id", "line", "unit_price")


@query("set02_signatures", "SELECT p_partkey, list_sort(list_distinct(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '))) AS tokens FROM part")
def _(t):
    return t.raw("part").select("p_partkey", text.ascii_signature(F.col("p_name")).alias("tokens"))


@query("nest02_array_sum", "SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def _(t):
    lines = t.raw("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity")).alias("lines"))
    return lines.select("l_orderkey", F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("quantity"))


@query("nest04_map_filter", "SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def _(t):
    m = F.map_filter(F.from_json("props", "map<string,bigint>"), lambda k, v: (v > 50) & ~k.startswith("_"))
    return t.raw("events").select("event_id", F.try_element_at(m, F.lit("k")).alias("k"))


# --- scans, filters, sinks --------------------------------------------------------------------------------------


@query("iso01_tenant_scan", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_custkey % 10 = 3")
def _(t):
    rows = t.raw("orders").select((F.col("o_custkey") % 10).cast("string").alias("organization_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return scans.TenantView({"requests": rows}, "3").find_all("requests", fields=["id", "status"])


@query("fil03_range", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def _(t):
    return t.raw("events").where("ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-20'").agg(F.count("*").alias("n"))


@query("fil05_name_contains", "SELECT s_suppkey AS supplier_id FROM supplier WHERE contains(lower(s_name), '#00000000')")
def _(t):
    return t.suppliers.where(scans.name_contains(F.col("name"), "#00000000")).select("supplier_id")


@query("snk03_upsert", R + """SELECT buyer_id, request_id, status FROM (SELECT *, row_number() OVER (PARTITION BY buyer_id ORDER BY created_at DESC, request_id DESC) AS k FROM requests) WHERE k = 1""")
def _(t):
    w = W.partitionBy("buyer_id").orderBy(F.desc("created_at"), F.desc("request_id"))
    return t.requests.withColumn("k", F.row_number().over(w)).where("k = 1").select("buyer_id", "request_id", "status")


@query("snk04_latest_status", "SELECT user_id AS quotation_id, arg_max(event_type, event_id) AS status, max(event_id) AS updated_at, count(*) AS steps FROM events GROUP BY 1")
def _(t):
    log = t.raw("events").select(F.col("user_id").alias("quotation_id"), F.col("event_type").alias("status"), F.col("event_id").alias("at"))
    return sinks.latest_status(log)


@query("snk06_order_numbers", PO + """SELECT po_id, supplier_id, printf('PO-%d-%04d', year(created_at), row_number() OVER (PARTITION BY supplier_id, year(created_at) ORDER BY created_at, po_id)) AS po_number FROM purchase_orders""")
def _(t):
    return agg.order_numbers(t.purchase_orders)


# --- functions --------------------------------------------------------------------------------------------------


@query("fn02_coerce_number", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) / 100.0::DOUBLE AS amount FROM orders")
def _(t):
    written = F.concat(F.lit("Rs. "), F.format_number("o_totalprice", 2), F.lit("/-"))
    return t.raw("orders").select("o_orderkey", numbers.coerce_number(written).alias("amount"))


@query("fn07_base_quantity", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN round(p_size * 0.001::DOUBLE, 6) WHEN 1 THEN round(p_size * 12.0::DOUBLE, 6) WHEN 2 THEN round(p_size * 0.3048::DOUBLE, 6) ELSE p_size END::DOUBLE AS quantity,
 CASE p_size % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'nos' WHEN 2 THEN 'm' ELSE 'box' END AS unit FROM part""")
def _(t):
    unit = F.element_at(F.array(F.lit("Gms"), F.lit("dozen"), F.lit("feet"), F.lit("cartons")), F.col("p_size") % 4 + 1)
    return t.raw("part").select("p_partkey", text.base_quantity(F.col("p_size").cast("double"), unit).alias("quantity"), text.base_unit(unit).alias("unit"))


@query("fn09_parse_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) AS c FROM orders")
def _(t):
    d = F.col("o_orderdate")
    return t.raw("orders").select("o_orderkey", dates.parse_date(F.date_format(d, "dd/MM/yyyy")).alias("a"), dates.parse_date(F.date_format(d, "d MMM yyyy")).alias("b"), dates.parse_date(F.concat(F.lit("dated "), F.date_format(d, "dd-MM-yyyy"))).alias("c"))


@query("fn11_gstin_state", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN lpad(CAST(1 + s_suppkey % 38 AS VARCHAR), 2, '0') END AS state_code FROM supplier""")
def _(t):
    code = F.lpad((1 + F.col("s_suppkey") % 38).cast("string"), 2, "0")
    number = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit(" "), code, F.lit("aabcs1429b1zq"))).otherwise("not one")
    return t.raw("supplier").select("s_suppkey", gstin.state_code(number).alias("state_code"))


@query("fn12_terms", """SELECT o_orderkey, CAST(o_orderkey % 90 + 1 AS INTEGER) AS validity, CAST(o_orderkey % 60 AS DOUBLE) AS advance, CASE o_orderkey % 3 WHEN 0 THEN 'fob' WHEN 1 THEN 'ex works' END AS incoterm FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    valid = F.concat(F.lit("Valid for "), k % 90 + 1, F.lit(" days"))
    terms = F.concat(k % 60, F.lit(" % Advance, rest on delivery"))
    way = F.element_at(F.array(F.lit("FOB Pune"), F.lit("Ex Works only"), F.lit("by road")), (k % 3 + 1).cast("int"))
    return t.raw("orders").select("o_orderkey", text.validity_days(valid).alias("validity"), text.advance_percent(terms).alias("advance"), text.incoterm(way).alias("incoterm"))


@query("fn14_language", """WITH c AS (SELECT doc_id, text, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin FROM documents)
 SELECT doc_id, CASE WHEN latin = 0 THEN 'unknown' ELSE 'en' END AS script FROM c""")
def _(t):
    return t.raw("documents").select("doc_id", text.detect_language(F.col("text")).alias("script"))


@query("fn18_normalize_item", "SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[a-z]+'), ' ') AS item FROM part")
def _(t):
    return t.raw("part").select("p_partkey", retrieval.normalize_item(F.col("p_name")).alias("item"))


@query("fn24_delays", PO + "SELECT po_id, delay_days, delay_days <= 0 AS on_time FROM purchase_orders WHERE status = 'delivered'")
def _(t):
    d = t.purchase_orders.where("status = 'delivered'")
    expected = F.to_date("created_at")
    done = po.record_delivery(d.drop("on_time").select("po_id", expected.alias("expected"), F.date_add(expected, F.col("delay_days")).alias("delivered_at")))
    return done.select("po_id", "delay_days", "on_time")


# --- time series ------------------------------------------------------------------------------------------------

_MONTHS = """WITH s AS (SELECT p_name AS item, date_trunc('month', l_shipdate)::DATE AS month, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 m AS (SELECT item, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM s GROUP BY 1),
 series AS (SELECT item, month, coalesce(q, 0.0)::DOUBLE AS quantity FROM m LEFT JOIN s USING (item, month))"""


def _demand(t: Tables) -> DataFrame:
    lines = t.raw("lineitem").join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
    return timeseries.monthly_series(lines, "p_name", "l_shipdate", "l_quantity")


@query("agg19_monthly_demand", _MONTHS + " SELECT item, month, quantity FROM series")
def _(t):
    return _demand(t)


@query("ts08_zero_months", _MONTHS + " SELECT item, count(*) AS months, count(*) FILTER (quantity = 0) AS zero_months, strftime(min(month), '%Y-%m') AS first_month, strftime(max(month), '%Y-%m') AS last_month FROM series GROUP BY 1")
def _(t):
    return timeseries.zero_months(_demand(t))


_BACKTEST = _MONTHS + """, r AS (SELECT item, quantity, row_number() OVER (PARTITION BY item ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY item) AS n FROM series),
 h AS (SELECT *, least(6, n // 4) AS h, i < n - least(6, n // 4) AS train FROM r),
 f AS (SELECT item, regr_slope(quantity, i) FILTER (train) AS slope, regr_intercept(quantity, i) FILTER (train) AS start FROM h GROUP BY 1),
 e AS (SELECT a.item, a.n, a.h, a.quantity AS y, greatest(f.start + f.slope * a.i, 0) AS lin, b.quantity AS sea FROM h a JOIN f USING (item) LEFT JOIN h b ON b.item = a.item AND b.i = a.i - 12 * ((a.i - (a.n - a.h)) // 12 + 1) WHERE NOT a.train),
 t AS (SELECT item, avg(CASE WHEN abs(y) + abs(lin) = 0 THEN 0 ELSE 200 * abs(y - lin) / (abs(y) + abs(lin)) END) AS l, avg(CASE WHEN n >= 12 + h THEN CASE WHEN abs(y) + abs(sea) = 0 THEN 0 ELSE 200 * abs(y - sea) / (abs(y) + abs(sea)) END END) AS s FROM e GROUP BY 1),
 c AS (SELECT item, count(*) AS months FROM series GROUP BY 1)
 SELECT item, months, CASE WHEN months >= 12 THEN 'ok' ELSE 'insufficient_data' END AS status, CASE WHEN months < 12 THEN NULL WHEN s <= l THEN 'seasonal_naive' ELSE 'linear_trend' END AS method,
 round(CASE WHEN months >= 12 THEN l END, 6) AS linear_smape, round(CASE WHEN months >= 12 THEN s END, 6) AS seasonal_smape FROM c LEFT JOIN t USING (item)"""


@query("dom18_backtest", _BACKTEST)
def _(t):
    return timeseries.backtest(_demand(t)).withColumns({"linear_smape": F.round("linear_smape", 6), "seasonal_smape": F.round("seasonal_smape", 6)})


@query("dom18_forecast", _MONTHS + f""", chosen AS (SELECT item, method, months FROM ({_BACKTEST}) WHERE status = 'ok'),
 r AS (SELECT item, month, quantity, row_number() OVER (PARTITION BY item ORDER BY month) - 1 AS i FROM series),
 fit AS (SELECT item, regr_slope(quantity, i) AS slope, regr_intercept(quantity, i) AS start, max(month) AS last FROM r GROUP BY 1)
 SELECT chosen.item, strftime(last + to_months(CAST(step AS INTEGER)), '%Y-%m') AS month, method,
 round(greatest(CASE WHEN method = 'linear_trend' THEN start + slope * (months + step - 1) ELSE quantity END, 0.0::DOUBLE), 6) AS quantity
 FROM chosen JOIN fit USING (item) CROSS JOIN generate_series(1, 3) g(step) LEFT JOIN (SELECT item, i, quantity FROM r) past ON past.item = chosen.item AND past.i = months - 12 + (step - 1) % 12""")
def _(t):
    return timeseries.forecast(_demand(t), 3).withColumn("quantity", F.round("quantity", 6))


# --- anomalies --------------------------------------------------------------------------------------------------

_STATUS = """CASE WHEN n >= 3 AND coalesce(sd, 0) <> 0 THEN CASE WHEN abs(unit_price - m) / sd >= 3 THEN 'HIGH_ANOMALY' WHEN abs(unit_price - m) / sd >= 2 THEN 'POSSIBLE_ANOMALY' ELSE 'NORMAL' END
 ELSE CASE WHEN abs((unit_price - m) / m) >= 0.6 THEN 'HIGH_ANOMALY' WHEN abs((unit_price - m) / m) >= 0.35 THEN 'POSSIBLE_ANOMALY' ELSE 'NORMAL' END END"""
_JUDGED = H + f""", st AS (SELECT item, avg(unit_price) AS m, stddev_samp(unit_price) AS sd, count(*) AS n FROM price_history GROUP BY 1),
 judged AS (SELECT p.*, {_STATUS} AS status FROM price_history p JOIN st USING (item)) """


def _judged(t: Tables) -> DataFrame:
    return anomaly.ladder(t.price_history.join(agg.price_stats(t.price_history), "item"))


@query("dom10_price_ladder", _JUDGED + "SELECT order_id, line, item, unit_price, status FROM judged")
def _(t):
    return _judged(t).select("order_id", "line", "item", "unit_price", "status")


@query("agg16_worst_status", _JUDGED + """SELECT supplier_id, CASE max(CASE status WHEN 'HIGH_ANOMALY' THEN 3 WHEN 'POSSIBLE_ANOMALY' THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH_ANOMALY' WHEN 2 THEN 'POSSIBLE_ANOMALY' ELSE 'NORMAL' END AS worst FROM judged GROUP BY 1""")
def _(t):
    return anomaly.worst_status(_judged(t), "supplier_id")


@query("agg20_status_shares", _JUDGED + """SELECT item, count(*) AS prices, median(unit_price) AS median, avg(CAST(status = 'POSSIBLE_ANOMALY' AS INTEGER)) AS possible, avg(CAST(status = 'HIGH_ANOMALY' AS INTEGER)) AS high FROM judged GROUP BY 1""")
def _(t):
    return anomaly.status_shares(_judged(t))


@query("dom25_fence", H + """, c AS (SELECT p_name AS item, max(p_retailprice) * 9 AS price FROM part GROUP BY 1), m AS (SELECT item, quantile_cont(unit_price, 0.5) AS median, count(*) AS n FROM price_history GROUP BY 1 HAVING count(*) >= 20),
 q AS (SELECT item, median, n, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM (SELECT item, median, n, ln(unit_price / median) AS x FROM price_history JOIN m USING (item)) GROUP BY ALL),
 b AS (SELECT *, ln(price / median) AS x, greatest(lo - ln(price / median), ln(price / median) - hi, 0) / CASE WHEN q3 <> q1 THEN q3 - q1 ELSE hi - lo END AS beyond FROM c JOIN q USING (item))
 SELECT item, price, n, median, price / median AS median_ratio, round(beyond, 9) AS beyond, CASE WHEN beyond >= 3 THEN 'HIGH_ANOMALY' WHEN beyond >= 1.5 THEN 'POSSIBLE_ANOMALY' END AS status FROM b""")
def _(t):
    c = t.raw("part").groupBy(F.col("p_name").alias("item")).agg((F.max("p_retailprice") * 9).alias("price"))
    return anomaly.fence(c, t.price_history).withColumn("beyond", F.round("beyond", 9))


@query("dom11_forest")
def _(t):
    c = t.raw("part").groupBy(F.col("p_name").alias("item")).agg(F.max("p_retailprice").alias("price"))
    return anomaly.forest_status(c, t.price_history)


# --- purchase orders --------------------------------------------------------------------------------------------


@query("dom14_tax_split", """WITH x AS (SELECT l_orderkey AS po_id, l_suppkey, CAST(round(l_tax * 100) AS INTEGER) AS rate, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS DOUBLE) AS taxable FROM lineitem GROUP BY 1, 2, 3),
 s AS (SELECT po_id * 1000000 + l_suppkey AS po_id, rate, taxable, c_nationkey AS b, s_nationkey AS s, taxable * rate / 100 AS tax FROM x JOIN orders ON po_id = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE rate <> 0),
 r AS (SELECT *, CAST(taxable * rate AS BIGINT) / 100.0::DOUBLE AS t, (CAST(taxable * rate AS BIGINT) + 1) // 2 / 100.0::DOUBLE AS h, CAST(taxable * rate AS BIGINT) // 2 / 100.0::DOUBLE AS g FROM s)
 SELECT po_id, 'CGST' AS name, rate / 2.0::DOUBLE AS tax_rate, h AS amount FROM r WHERE b = s UNION ALL SELECT po_id, 'SGST', rate / 2.0::DOUBLE, g FROM r WHERE b = s UNION ALL SELECT po_id, 'IGST', rate::DOUBLE, t FROM r WHERE b <> s""")
def _(t):
    li = t.raw("lineitem")
    x = li.groupBy("l_orderkey", "l_suppkey", F.round(F.col("l_tax") * 100).cast("int").alias("rate")).agg(F.sum(F.round("l_extendedprice").cast("long")).cast("double").alias("taxable"))
    o = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("buyer_state"))
    s = t.raw("supplier").select("s_suppkey", F.col("s_nationkey").alias("supplier_state"))
    rows = x.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return po.tax_split(rows.select((F.col("l_orderkey") * 1000000 + F.col("l_suppkey")).alias("po_id"), "rate", "taxable", "buyer_state", "supplier_state"))


@query("dom15_transitions", """WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' WHEN 2 THEN 'issued' WHEN 3 THEN 'delivered' ELSE 'closed' END AS status,
 CASE o_orderkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'issued' ELSE 'cancelled' END AS wanted FROM orders),
 k AS (SELECT *, (status, wanted) IN (('draft', 'approved'), ('draft', 'cancelled'), ('approved', 'issued'), ('approved', 'cancelled'), ('issued', 'delivered'), ('issued', 'cancelled'), ('delivered', 'closed')) AS ok FROM r)
 SELECT id, status, wanted, CASE WHEN ok THEN wanted ELSE status END AS new_status, CASE WHEN NOT ok THEN status || ' to ' || wanted END AS error FROM k""")
def _(t):
    k = F.col("o_orderkey")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    return po.transitions(t.raw("orders").select(k.alias("id"), pick(5, "draft", "approved", "issued", "delivered", "closed").alias("status"), pick(3, "approved", "issued", "cancelled").alias("wanted")))


@query("dom24_overdue", PO + """SELECT po_id, CAST(date_diff('day', created_at::DATE, DATE '2000-01-01') AS INTEGER) AS days_late FROM purchase_orders WHERE status = 'issued' AND created_at < TIMESTAMP '2000-01-01' AND po_id % 10 <> 0""")
def _(t):
    orders = t.purchase_orders.withColumn("expected", F.col("created_at"))
    drafts = t.purchase_orders.where("po_id % 10 = 0").select("po_id")
    return po.overdue(orders, drafts, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")).select("po_id", "days_late")


# --- reliability, policy, risk ----------------------------------------------------------------------------------


@query("dom12_reliability", Q + """, q AS (SELECT supplier_id, count(*) AS n, avg(CAST(error_count = 0 AND warning_count <= 2 AS INTEGER)) AS quality, avg(CAST(quotation_id % 10 <> 0 AS INTEGER)) AS usable FROM
 (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY created_at DESC, quotation_id DESC) AS k FROM quotations) WHERE k <= 100 GROUP BY 1)
 SELECT s_suppkey AS supplier_id, round((1 + CAST(s_suppkey % 2 = 0 AS INTEGER)) / 4.0::DOUBLE * 0.3::DOUBLE + least(coalesce(n, 0) / 5.0::DOUBLE, 1.0) * 0.25::DOUBLE + coalesce(quality, 0.5) * 0.25::DOUBLE + coalesce(usable, 0.5) * 0.2::DOUBLE, 4) AS reliability,
 CAST(coalesce(n, 0) AS BIGINT) AS sample_size FROM supplier LEFT JOIN q ON supplier_id = s_suppkey""")
def _(t):
    s = t.suppliers.select("supplier_id", F.lit("a@b.in").alias("email"), F.when(F.col("supplier_id") % 2 == 0, "1").alias("phone"), F.lit("").alias("gst_number"), F.lit(None).cast("string").alias("address"))
    q = t.quotations.withColumn("processing_status", F.when(F.col("quotation_id") % 10 != 0, "COMPLETED").otherwise("FAILED"))
    return reliability.reliability(s, q)


@query("dom23_autopilot", with_tables("requests", "quotations") + """SELECT request_id, n FROM requests JOIN (SELECT request_id, count(*) AS n FROM quotations GROUP BY 1 HAVING count(*) >= 2) USING (request_id) WHERE status = 'open' AND request_id % 7 <> 0""")
def _(t):
    runs = t.requests.where("request_id % 7 = 0").select("request_id")
    return reliability.autopilot(t.requests, t.quotations, runs).select("request_id", "n")


@query("dom19_risk", f"""WITH f AS ({_FEATURES}), p AS (SELECT *, 1 - prior_on_time_rate AS p FROM f)
 SELECT *, CASE WHEN p >= 0.3::DOUBLE THEN 'high' WHEN p >= 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS level, coalesce(p >= 0.15::DOUBLE, FALSE) AS concern,
 concat_ws(',', CASE WHEN prior_count = 0 THEN 'no history' END, CASE WHEN prior_count > 0 AND recent_late_rate >= 0.3::DOUBLE THEN 'late recently' END, CASE WHEN recent_late_rate = 0 AND least(prior_count, 10) >= 3 THEN 'on time recently' END,
 CASE WHEN prior_count >= 5 AND prior_on_time_rate >= 0.9::DOUBLE THEN 'reliable' END, CASE WHEN prior_count > 0 AND prior_on_time_rate < 0.7::DOUBLE THEN 'often late' END, CASE WHEN prior_mean_delay >= 7 AND prior_on_time_rate < 1 THEN 'long delays' END) AS signals FROM p""")
def _(t):
    f = features.as_of_features(t.deliveries)
    return features.risk(f.withColumn("p", 1 - F.col("prior_on_time_rate")), "p", 0.3)


@query("ml09_baseline_metrics", D + """, o AS (SELECT *, row_number() OVER () AS rn FROM deliveries),
 b AS (SELECT o.rn, CAST(any_value(o.delivered > o.scheduled) AS INTEGER) AS label, avg(CAST(d.delivered > d.scheduled AS INTEGER)) AS p, count(*) AS n FROM o JOIN deliveries d ON d.supplier_key = o.supplier_key AND d.delivered < o.scheduled - 30 GROUP BY 1)
 SELECT count(*) AS n, round(avg((p - label) * (p - label)), 6) AS brier, count(*) FILTER (p >= 0.18 AND label = 1) AS tp, count(*) FILTER (p >= 0.18 AND label = 0) AS fp FROM b""")
def _(t):
    f = features.as_of_features(t.deliveries).where("prior_count > 0")
    p = 1 - F.col("prior_on_time_rate")
    late = (F.date_add("scheduled", 0) < F.date_sub("scheduled", ((F.floor(F.col("line_id") / 10) * 7 + (F.col("line_id") % 10) * 3) % 21 - 4).cast("int"))).cast("int")
    s = f.select(p.alias("p"), late.alias("label"))
    return s.agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") - F.col("label")) * (F.col("p") - F.col("label"))), 6).alias("brier"), F.count_if((F.col("p") >= 0.18) & (F.col("label") == 1)).alias("tp"), F.count_if((F.col("p") >= 0.18) & (F.col("label") == 0)).alias("fp"))


@query("ml12_retrain_gate", D + "SELECT count(*) >= 50 AS enough_orders, count(DISTINCT year(scheduled)) >= 2 AS enough_years FROM deliveries")
def _(t):
    return ml.may_train(t.deliveries)


# --- extraction, matching, retrieval ----------------------------------------------------------------------------


@query("dom04_validation", """WITH x AS (SELECT l_orderkey, p_name AS name, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q, l_extendedprice / l_quantity AS p, l_tax * 100 AS tax, CASE WHEN l_linenumber <> 4 THEN l_extendedprice END AS total, l_extendedprice AS e FROM lineitem JOIN part ON l_partkey = p_partkey),
 i AS (SELECT *, coalesce(name IS NULL OR trim(name) = '', FALSE)::INT + coalesce(q <= 0, FALSE)::INT + coalesce(p < 0, FALSE)::INT + coalesce(total < 0, FALSE)::INT AS errors,
  coalesce(q > 1e6, FALSE)::INT + coalesce(p > 1e7, FALSE)::INT + coalesce(tax < 0 OR tax > 40, FALSE)::INT + coalesce(abs(q * p - total) > greatest(1.0, 0.02 * greatest(abs(q * p), abs(total), 1.0)), FALSE)::INT + (q IS NULL OR p IS NULL OR total IS NULL)::INT AS warnings,
  (name IS NOT NULL)::INT + (q IS NOT NULL)::INT + (p IS NOT NULL)::INT + (total IS NOT NULL)::INT AS filled FROM x),
 g AS (SELECT l_orderkey, sum(errors) + (sum(e) * 1.18 <= 0)::INT AS errors, sum(warnings) + (sum(e) * 1.18 > 1e9)::INT AS warnings, round(CAST(CAST(sum(filled)::DOUBLE / (4 * count(*)) AS VARCHAR) AS DECIMAL(38, 20)), 4) AS extraction FROM i GROUP BY 1),
 n AS (SELECT *, round(CAST(greatest(0.0, 1 - least(errors * 0.15 + warnings * 0.03, 0.6)) AS DECIMAL(18, 8)), 4) AS normal FROM g)
 SELECT l_orderkey, CAST(errors AS INTEGER) AS error_count, CAST(warnings AS INTEGER) AS warning_count, errors > 0 OR warnings >= 3 AS needs_review, CAST(extraction AS DOUBLE) AS extraction_confidence, CAST(normal AS DOUBLE) AS normalization_confidence,
 CAST(round(CAST(CAST((extraction::DOUBLE + normal::DOUBLE) / 2 AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE) AS overall_confidence FROM n""")
def _(t):
    li = t.raw("lineitem").join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
    item = F.struct(
        F.col("p_name").alias("original_name"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_tax") * 100).alias("gst_percentage"), F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice")).alias("total_price"),
    )
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("l_extendedprice").alias("subtotal"))
    rows = g.select(
        "l_orderkey", "items", F.struct(F.lit("Shree Steel").alias("name"), F.lit("x@y.in").alias("email"), F.lit("27AABCS1429B1ZQ").alias("gst_number")).alias("supplier"),
        F.struct(F.lit("15/09/1999").alias("date")).alias("quotation"),
        F.struct(F.col("subtotal"), F.lit(None).cast("double").alias("tax_amount"), F.lit(18.0).alias("tax_percentage"), (F.col("subtotal") * 1.18).alias("total_amount"), F.lit(None).cast("double").alias("transportation_cost"), F.lit(7).alias("delivery_days"), F.lit(30).alias("payment_days")).alias("commercials"),
    )
    v = validation.confidence(validation.validate(rows, F.lit("2000-01-01").cast("date")))
    return v.select("l_orderkey", "error_count", "warning_count", "needs_review", "extraction_confidence", "normalization_confidence", "overall_confidence")


@query("join08_supplier_resolution", with_tables("quotations", "suppliers") + """, s AS (SELECT supplier_id, name, '27AABCS' || lpad(CAST(supplier_id % 10000 AS VARCHAR), 4, '0') || 'B1ZQ' AS gst, name || '@mail.in' AS mail FROM suppliers),
 k AS (SELECT *, min(supplier_id) OVER (PARTITION BY gst) AS g, min(supplier_id) OVER (PARTITION BY lower(trim(mail))) AS m, min(supplier_id) OVER (PARTITION BY lower(trim(name))) AS n, min(supplier_id) OVER (PARTITION BY trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))) AS f FROM s)
 SELECT quotation_id AS quote_id, CASE WHEN quotation_id % 4 = 0 THEN lower(gst) END AS gst_number, CASE WHEN quotation_id % 4 = 1 THEN upper(mail) END AS email, CASE quotation_id % 4 WHEN 2 THEN upper(name) WHEN 3 THEN name || '?' END AS name,
 CASE quotation_id % 4 WHEN 0 THEN g WHEN 1 THEN m WHEN 2 THEN n ELSE f END AS supplier_id, CASE quotation_id % 4 WHEN 0 THEN 'gst' WHEN 1 THEN 'email' WHEN 2 THEN 'name' ELSE 'folded' END AS matched_by FROM quotations JOIN k USING (supplier_id)""")
def _(t):
    s = t.suppliers.select("supplier_id", F.concat(F.lit("27AABCS"), F.lpad((F.col("supplier_id") % 10000).cast("string"), 4, "0"), F.lit("B1ZQ")).alias("gst_number"), F.concat("name", F.lit("@mail.in")).alias("email"), "name")
    q = t.quotations.select(F.col("quotation_id").alias("quote_id"), "supplier_id").join(s, "supplier_id")
    kind = F.col("quote_id") % 4
    quotes = q.select("quote_id", F.when(kind == 0, F.lower("gst_number")).alias("gst_number"), F.when(kind == 1, F.upper("email")).alias("email"), F.when(kind == 2, F.upper("name")).when(kind == 3, F.concat("name", F.lit("?"))).alias("name"))
    return matching.resolve_suppliers(quotes, s)


@query("dom07_item_matching")
def _(t):
    p = t.raw("part").select("p_partkey", "p_name", (F.col("p_partkey") % 50).alias("request_id"))
    items = p.select("request_id", F.col("p_partkey").alias("request_item_id"), F.concat(F.col("p_name"), F.lit(" 10mm")).alias("name"), F.lit("pcs").alias("unit"))
    # a third of the quoted names are spelled backwards, for items that match nothing
    quoted = F.when(F.col("p_partkey") % 3 == 1, F.reverse("p_name")).when(F.col("p_partkey") % 2 == 0, F.concat(F.upper("p_name"), F.lit(" 10 MM"))).otherwise(F.concat(F.lit("best "), F.col("p_name")))
    lines = p.select("request_id", F.lit(1).alias("quotation_id"), F.col("p_partkey").alias("line_id"), quoted.alias("name"), F.lit("nos").alias("unit"))
    return matching.match_items(items, lines, blank_matches=False).select("request_item_id", "quotation_id", "line_id", "score", "method", "ambiguous")


@query("agg14_match_coverage")
def _(t):
    return matching.coverage(PLANS["dom07_item_matching"](t))


#: Names whose scores have closed forms: the same, one word more, another size, none; quoted in pieces or by weight.
_BRANCHES = """WITH p AS (SELECT p_partkey AS k, length(p_name) AS n, p_partkey % 4 AS c, p_partkey % 8 < 4 AS agree FROM part),
 m AS (SELECT k AS request_item_id, k % 10 AS quotation_id, k AS line_id, CASE c WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN round(0.8::DOUBLE + 0.4::DOUBLE * n / (2 * n + 3), 4) WHEN 2 THEN round((1 - 1.0::DOUBLE / (n + 6)) * 0.45::DOUBLE, 4) ELSE 0.0::DOUBLE END AS score,
 CASE WHEN c = 0 THEN 'exact' WHEN c = 1 AND agree THEN 'auto' WHEN c = 1 THEN 'review' ELSE 'unmatched' END AS method FROM p)"""


def _branches(t: Tables) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    p = t.raw("part").select(k.alias("request_id"), k.alias("request_item_id"), (k % 10).alias("quotation_id"), k.alias("line_id"), name, (k % 4).alias("c"), F.when(k % 8 < 4, "nos").otherwise("kg").alias("offered"))
    items = p.select("request_id", "request_item_id", F.when(F.col("c") == 2, F.concat(name, F.lit(" 10mm"))).otherwise(F.upper(name)).alias("name"), F.lit("pcs").alias("unit"))
    quoted = F.when(F.col("c") == 0, name).when(F.col("c") == 1, F.concat(name, F.lit(" zz"))).when(F.col("c") == 2, F.concat(name, F.lit(" 20 MM"))).otherwise("-")
    return matching.match_items(items, p.select("request_id", "quotation_id", "line_id", quoted.alias("name"), F.col("offered").alias("unit")), blank_matches=False)


@query("dom07_branches", _BRANCHES + " SELECT request_item_id, quotation_id, line_id, score, method, false AS ambiguous FROM m")
def _(t):
    return _branches(t).select("request_item_id", "quotation_id", "line_id", "score", "method", "ambiguous")


@query("agg14_branches", _BRANCHES + """ SELECT quotation_id, count(*) FILTER (method IN ('exact', 'auto')) AS matched, count(*) FILTER (method = 'review') AS review, count(*) FILTER (method = 'unmatched') AS unmatched, count(*) AS items,
 count(*) FILTER (method <> 'unmatched') / count(*) AS coverage FROM m GROUP BY 1""")
def _(t):
    return matching.coverage(_branches(t))


STOP_WORDS = "a an and are as at be by for from in is it of on or that the this to with".split()


def _retrieval_sql() -> str:
    """TF-IDF of words without stop words and their pairs, and of character 3-5-grams, step by step over all documents."""
    side = """SELECT {key} AS id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains(stop, w)) AS w,
 list_transform(list_filter(regexp_split_to_array(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x85\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda x: x <> ''), lambda x: ' ' || x || ' ') AS c FROM {table}, stops"""
    words = "SELECT side, 0 AS block, id, unnest(w) AS term FROM texts UNION ALL SELECT side, 0, id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM texts"
    grams = " UNION ALL ".join(f"SELECT side, 1, id, unnest(list_transform(generate_series(1, length(x) - {n - 1}), lambda i: substring(x, i, {n}))) FROM padded" for n in (3, 4, 5))
    return f"""WITH stops AS (SELECT {STOP_WORDS} AS stop), texts AS (SELECT 'd' AS side, * FROM ({side.format(key="doc_id", table="documents")}) UNION ALL SELECT 'q', * FROM ({side.format(key="item_id", table="benchmark")})),
 padded AS (SELECT side, id, unnest(c) AS x FROM texts), t AS (SELECT side, block, id, term, count(*) AS tf FROM ({words} UNION ALL {grams}) GROUP BY ALL),
 idf AS (SELECT block, term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM t WHERE side = 'd' GROUP BY 1, 2 HAVING count(*) > block),
 v AS (SELECT side, block, id, term, (1 + ln(tf)) * idf AS w FROM t JOIN idf USING (block, term)), norm AS (SELECT side, block, id, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1, 2, 3), held AS (SELECT side, id, sqrt(count(*)) AS held FROM norm GROUP BY 1, 2),
 u AS (SELECT side, block, id, term, w / norm / held AS w FROM v JOIN norm USING (side, block, id) JOIN held USING (side, id)),
 s AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.w * d.w) AS score FROM u q JOIN u d USING (block, term) WHERE q.side = 'q' AND d.side = 'd' GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""


@query("dom20_retrieval", _retrieval_sql())
def _(t):
    q = t.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.search(q, t.raw("documents").select("doc_id", "text"), k=3, chars=True, stop_words=STOP_WORDS).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
