"""Functions by name give what the DataFrame forms give."""

import random

from pyspark.sql import functions as F

from bidlake.functions import sql, text
from bidlake.operators import extraction

PIECES = ["PVC", "pipe", "2", "inch", "10", "7", "99.5", "400", "3", "60", "nos", "12.50", "1,250.00", "125", "pcs", "Qty", "Rate", "GST", "Amount", "45", "18", "Total", "1.", "2)", "total", "-", "|", "é", "kg", ",", "1e5", "123456789.5", " ", "​", "freight", "Sub", "net:"]


def texts(n=1500, seed=3):
    rng = random.Random(seed)
    line = lambda: rng.choice(("", " ", "  ")) + rng.choice((" ", "  ", "\t")).join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))
    return [(k, rng.choice(("\n", "\r\n", "\x85")).join(line() for _ in range(rng.randint(0, 8)))) for k in range(n)] + [(n, None), (n + 1, "")]


def test_text_items(spark):
    sql.register(spark)
    df = spark.createDataFrame(texts(), "id int, text string")
    df.createOrReplaceTempView("quotation_texts")
    plain = lambda rows: sorted((tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in rows), key=str)
    want = plain(extraction.text_items(df).collect())
    got = plain(spark.sql("SELECT t.id, i.* FROM quotation_texts t, LATERAL text_items(t.text) i").collect())
    assert got == want and len(want) > 100
    assert {len(r[-1]) for r in want} == {0, 1, 2}


def test_text_items_of_odd_digits_and_endings(spark, monkeypatch):
    """Digits and unit letters outside ASCII are none, as in the columns; of a text without lines that may be items nothing else is worked out."""
    odd = ["PVC pipe \u0967\u0966 20 30", "PVC pipe 10 20 \u0969", "PVC pipe 10 \u212ags 20 30", "PVC pipe 10 kgs 20 30,", "PVC pipe 10 20 30\t", "PVC pipe 10 20 30 \u00a0", "PVC pipe 10 20 30 nos", "PVC pipe 10 20 30."]
    df = spark.createDataFrame(list(enumerate(odd)), "id int, text string")
    want = sorted((r.id, *[r[c] for c in ("line", "original_name", "quantity", "unit", "unit_price", "total_price", "attributes")]) for r in extraction.text_items(df).collect())
    got = sorted((k, *[r[i] for i in (0, 1, 2, 3, 4, 6, 7)]) for k, raw in enumerate(odd) for r in sql.text_items_of(raw))
    assert got == want and {r[0] for r in want} >= {3, 4, 5}
    monkeypatch.setattr(sql, "_roles", None)
    assert list(sql.text_items_of("Qty Rate Amount\nDelivery within 7 days\nPVC pipe 10 nos each\nDate: 05/03/2024")) == []


def test_units(spark):
    sql.register(spark)
    units = [(k, u) for k, u in enumerate(["Nos", "PCS.", "Btl", "नग", "kgs", "Ltr", "ML", "inch", '"', "dozen", "banana", " TON ", "", None, "feets", "mm"])]
    df = spark.createDataFrame(units, "id int, unit string")
    df.createOrReplaceTempView("units")
    want = df.select("id", text.normalize_unit(F.col("unit")), text.base_unit(F.col("unit")), text.base_quantity(F.lit(2.5), F.col("unit"))).collect()
    got = spark.sql("SELECT id, normalize_unit(unit), base_unit_of(unit), base_quantity(2.5D, unit) FROM units").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and any(r[1] == "kg" for r in got)
    plan = spark.sql("SELECT normalize_unit(unit) FROM units")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan  # opened up, not called


def test_scores(spark):
    sql.register(spark)
    r = spark.sql("SELECT normalize_text('PVC Pipe 2\"') a, similarity('hex bolt', 'Hex bolts') b").first()
    assert r.a == text.fold_text('PVC Pipe 2"') and r.b == text.similarity_of("hex bolt", "Hex bolts")
