"""Star-schema tables as procurement tables, in Spark and as SQL common table expressions.

Amounts are summed as whole millionths, so both engines get the same number whatever the
order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITTED = ("issued", "delivered", "closed")


class Tables:
    """The tables of one folder. Every property is a plan; nothing is read before an action."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def quotations(self) -> DataFrame:
        """One row per (request, supplier): totals, terms with gaps, coverage and issue counts."""
        micro = (
            F.round(F.col("l_extendedprice") * 100).cast("long")
            * F.round((1 - F.col("l_discount")) * 100).cast("long")
            * F.round((1 + F.col("l_tax")) * 100).cast("long")
        )
        q = (
            self.raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").alias("supplier_id"))
            .agg(
                (F.sum(micro) / 1e6).alias("landed"),
                F.count("*").alias("n_lines"),
                F.countDistinct("l_partkey").alias("n_parts"),
                F.count_if(F.col("l_returnflag") == "R").alias("error_count"),
                F.count_if(F.col("l_returnflag") == "A").alias("warning_count"),
                F.max("l_shipdate").alias("created_at"),
                F.min("l_linestatus").alias("line_status"),
            )
        )
        s = F.col("supplier_id")
        return q.select(
            "*", (s * 1000000 + F.col("request_id")).alias("quotation_id"), (1 + s % 30).cast("int").alias("delivery_days"),
            F.when(s % 7 != 0, 15 * (s % 5)).cast("int").alias("payment_days"),
        )

    @property
    def purchase_orders(self) -> DataFrame:
        """The same grain: delivered where all lines are final, with a three-valued on_time."""
        late = (F.col("request_id") * 7 + F.col("supplier_id") * 3) % 21 - 4
        delivered = F.col("line_status") == "F"
        return self.quotations.select(
            "request_id", "supplier_id", F.col("quotation_id").alias("po_id"), F.col("landed").alias("total"), "created_at",
            F.when(delivered, "delivered").otherwise("issued").alias("status"),
            F.when(delivered, late).cast("int").alias("delay_days"), F.when(delivered, late <= 0).alias("on_time"),
        )

    @property
    def deliveries(self) -> DataFrame:
        """Orders as the late-delivery model sees them. ``line_id`` makes the order of equal times total."""
        li = self.raw("lineitem")
        shift = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % 21 - 4
        return li.select(
            F.col("l_suppkey").alias("supplier_key"), F.col("l_shipdate").cast("date").alias("delivered"),
            F.date_add(F.col("l_shipdate").cast("date"), shift.cast("int")).alias("scheduled"),
            F.col("l_extendedprice").alias("order_value"), F.col("l_quantity").alias("quantity"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), F.col("l_partkey").alias("part_id"),
        )

    @property
    def price_history(self) -> DataFrame:
        part = self.raw("part").select(F.col("p_partkey"), F.col("p_name").alias("item"))
        li = self.raw("lineitem").where("l_quantity > 0")
        price = (F.round(F.col("l_extendedprice") * 100) / 100) / F.col("l_quantity")
        return li.join(part, li.l_partkey == part.p_partkey).select(
            "item", price.alias("unit_price"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("created_at"),
            F.col("l_suppkey").alias("supplier_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        )

    @property
    def requests(self) -> DataFrame:
        o = self.raw("orders")
        status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("comparing")
        return o.select(F.col("o_orderkey").alias("request_id"), status.alias("status"), F.col("o_custkey").alias("buyer_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("priority"))

    @property
    def suppliers(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("state_code"), F.col("s_acctbal").alias("balance"))


# The same relations for the other engine.
SQL = {
    "quotations": """quotations AS (SELECT *, supplier_id * 1000000 + request_id AS quotation_id, CAST(1 + supplier_id % 30 AS INTEGER) AS delivery_days,
 CAST(CASE WHEN supplier_id % 7 <> 0 THEN 15 * (supplier_id % 5) END AS INTEGER) AS payment_days FROM (
 SELECT l_orderkey AS request_id, l_suppkey AS supplier_id,
 CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT) * CAST(round((1 + l_tax) * 100) AS BIGINT)) AS BIGINT) / 1e6 AS landed,
 count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts, count(*) FILTER (l_returnflag = 'R') AS error_count, count(*) FILTER (l_returnflag = 'A') AS warning_count,
 max(l_shipdate) AS created_at, min(l_linestatus) AS line_status FROM lineitem GROUP BY 1, 2))""",
    "purchase_orders": """purchase_orders AS (SELECT request_id, supplier_id, quotation_id AS po_id, landed AS total, created_at,
 CASE WHEN line_status = 'F' THEN 'delivered' ELSE 'issued' END AS status,
 CASE WHEN line_status = 'F' THEN CAST((request_id * 7 + supplier_id * 3) % 21 - 4 AS INTEGER) END AS delay_days,
 CASE WHEN line_status = 'F' THEN (request_id * 7 + supplier_id * 3) % 21 - 4 <= 0 END AS on_time FROM quotations)""",
    "deliveries": """deliveries AS (SELECT l_suppkey AS supplier_key, CAST(l_shipdate AS DATE) AS delivered,
 CAST(l_shipdate AS DATE) + CAST((l_orderkey * 7 + l_linenumber * 3) % 21 - 4 AS INTEGER) AS scheduled,
 l_extendedprice AS order_value, l_quantity AS quantity, l_orderkey * 10 + l_linenumber AS line_id, l_partkey AS part_id FROM lineitem)""",
    "price_history": """price_history AS (SELECT p_name AS item, (round(l_extendedprice * 100) / 100) / l_quantity AS unit_price, l_quantity AS quantity, l_shipdate AS created_at,
 l_suppkey AS supplier_id, l_orderkey AS order_id, l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0)""",
    "requests": """requests AS (SELECT o_orderkey AS request_id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'comparing' END AS status,
 o_custkey AS buyer_id, o_orderdate AS created_at, o_orderpriority AS priority FROM orders)""",
    "suppliers": "suppliers AS (SELECT s_suppkey AS supplier_id, s_name AS name, s_nationkey AS state_code, s_acctbal AS balance FROM supplier)",
}
_NEEDS = {"purchase_orders": ("quotations",)}


def with_tables(*names: str) -> str:
    """The beginning of a query over these relations."""
    wanted: list[str] = []
    for name in names:
        for x in (*_NEEDS.get(name, ()), name):
            if x not in wanted:
                wanted.append(x)
    return "WITH " + ", ".join(SQL[x] for x in wanted) + " "
