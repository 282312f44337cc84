"""Roll-ups by file equal the full run, whatever came, changed or went, and read new files alone."""

import os
import shutil

from pyspark.sql import functions as F

from bidlake.operators import aggregates, rollups
from bidlake.sources.driver import Tables


def plain(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_spend_after_files_come_change_and_go(spark, small, tmp_path):
    orders = Tables(spark, small).purchase_orders.persist()
    source, path = str(tmp_path / "orders"), str(tmp_path / "state")
    put = lambda k, df: df.coalesce(1).write.mode("overwrite").parquet(f"{source}/part={k}")
    piece = lambda k: orders.where(F.col("po_id") % 5 == k)
    read = []

    def check(kept, added, dropped):
        roll = rollups.spend_roll_up(spark, source, path)
        partials = roll._partials
        roll._partials = lambda names: (read.append(len(names)), partials(names))[1]
        assert roll.refresh() == {"added": added, "dropped": dropped}
        whole = kept[0]
        for df in kept[1:]:
            whole = whole.unionByName(df)
        states = roll.result()
        assert plain(rollups.spend_by_supplier(states)) == plain(aggregates.spend_by_supplier(whole))
        assert plain(rollups.spend_by_month(states)) == plain(aggregates.spend_by_month(whole))
        done = aggregates.committed(whole)
        assert rollups.fingerprint(states).first() == done.agg(F.count("*").alias("n"), F.max("created_at").alias("updated_at")).first()

    for k in (0, 1):
        put(k, piece(k))
    check([piece(0), piece(1)], 2, 0)
    check([piece(0), piece(1)], 0, 0)  # nothing new
    put(2, piece(2))
    check([piece(0), piece(1), piece(2)], 1, 0)  # a file came
    shutil.rmtree(f"{source}/part=1")
    check([piece(0), piece(2)], 0, 1)  # one went
    put(0, piece(3))
    check([piece(2), piece(3)], 1, 1)  # one was written anew under another name
    name = next(n for n in os.listdir(f"{source}/part=2") if n.endswith(".parquet"))
    put(4, piece(4))
    new = next(n for n in os.listdir(f"{source}/part=4") if n.endswith(".parquet"))
    os.replace(f"{source}/part=4/{new}", f"{source}/part=2/{name}")
    for other in (f"{source}/part=4", f"{source}/part=2/.{name}.crc"):
        shutil.rmtree(other) if os.path.isdir(other) else os.remove(other)
    check([piece(3), piece(4)], 1, 0)  # one changed under its name
    assert read == [2, 1, 1, 1]
    orders.unpersist()


def test_items_and_a_crash(spark, tmp_path, monkeypatch):
    source, path = str(tmp_path / "lines"), str(tmp_path / "state")
    rows = lambda *x: spark.createDataFrame(list(x), "item string, quantity double, amount double").coalesce(1)
    rows(("a", 1.0, 10.0), ("b", 2.0, 20.0)).write.parquet(f"{source}/1")
    roll = rollups.item_roll_up(spark, source, path)
    roll.refresh()
    rows(("a", 5.0, 1.5), (None, 1.0, 1.0)).write.parquet(f"{source}/2")
    monkeypatch.setattr(roll.files, "merge", lambda *a: 1 / 0)  # dies between states and list
    try:
        roll.refresh()
    except ZeroDivisionError:
        pass
    again = rollups.item_roll_up(spark, source, path)
    assert again.refresh() == {"added": 1, "dropped": 0}
    assert plain(rollups.spend_by_item(again.result())) == plain(aggregates.spend_by_item(spark.read.parquet(f"{source}/1", f"{source}/2")))
