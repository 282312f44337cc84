"""The keyed table: merges touch their buckets alone, batches count once, writers that meet lose nothing."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from bidlake.sources import sinks
from bidlake.sources.keyed import FOLDERS, KeyedTable

SCHEMA = "id long, name string, owner_id long, history array<struct<s:string>>, updated_at timestamp"


def rows_of(spark, ids, name="x"):
    return spark.createDataFrame([(i, f"{name}{i}", i, [], dt.datetime(2020, 1, 1)) for i in ids], SCHEMA)


def files(table):
    """Data files by bucket, as the last commit has them."""
    return {b: {f"{f}/{n}" for f in fs for n in os.listdir(f"{table.path}/{f}") if n.endswith(".parquet")} for b, fs in table.state()["folders"].items()}


def plain(df):
    return sorted((tuple(r) for r in df.drop("updated_at").collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"], buckets=8)
    assert t.create(rows_of(spark, range(200))) and not t.create(rows_of(spark, range(3)))
    return t


def test_merges_equal_whole_table(spark, table):
    old = rows_of(spark, range(200))
    change = spark.createDataFrame([(3, "new", None), (500, "nobody", None)], "id long, name string, owner_id long")
    newer = rows_of(spark, [7, 300], "y").withColumn("updated_at", F.lit(dt.datetime(2021, 1, 1)))
    push = spark.createDataFrame([(9, 1, "seen")], "id long, at int, s string")
    gone = spark.createDataFrame([(11,)], "id long")
    steps = [
        (change, lambda x: sinks.update(x, change, "id")), (newer, lambda x: sinks.upsert(x, newer, ["id"])),
        (push, lambda x: sinks.raw_update(x, push.limit(0).select("id", F.lit("").alias("name")), "id", push)), (gone, lambda x: sinks.delete(x, gone, "id")),
    ]
    for changes, how in steps:
        before, old = files(table), how(old)
        touched = {str(r[0]) for r in changes.select(table.bucket()).collect()}
        assert table.merge(changes, how)
        after = files(table)
        assert {b for b in before if after[b] != before[b]} == touched & set(before) and len(touched) < 8
        assert plain(table.read()) == plain(old)
    assert table.read().where("id = 3").first().owner_id is None and table.vacuum() == 0


def test_batches_count_once(spark, table):
    bump = lambda old, new: old.join(new.select("id"), "id", "left_semi").withColumn("owner_id", F.col("owner_id") + 1).unionByName(old.join(new.select("id"), "id", "left_anti"))
    for query, batch in (("q", 0), ("q", 0), ("q", 1), ("other", 0), ("q", 1)):
        table.merge_sink(query, bump)(rows_of(spark, [5]), batch)
    assert table.read().where("id = 5").first().owner_id == 5 + 3


def test_two_checkpoints_and_a_killed_batch(spark, tmp_path, monkeypatch):
    """The same source under two checkpoints, where one batch dies after its files are written."""
    source, target = str(tmp_path / "in"), KeyedTable(spark, str(tmp_path / "t"), ["org", "reference"], buckets=4)
    schema = "org string, reference string, n int"
    for k in range(4):
        spark.createDataFrame([("a", f"r{v}", 10 * k + v) for v in range(k, k + 6)] + [("b", "r0", k)], schema).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint, query):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = stream.writeStream.foreachBatch(target.sink(query, ["n"])).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()

    commit, calls = target._commit, []

    def dies(state):
        calls.append(state)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return commit(state)

    monkeypatch.setattr(target, "_commit", dies)
    with pytest.raises(Exception, match="killed"):
        run("one", "first")
    monkeypatch.setattr(target, "_commit", commit)
    assert target.read().count() == 7
    run("one", "first")  # goes on with the batch that died
    stored = sorted(map(tuple, target.read().select("org", "reference", "n").collect()))
    assert len(stored) == len({r[:2] for r in stored}) == 10
    names = files(target)
    run("two", "second")  # a new checkpoint reads all again
    assert sorted(map(tuple, target.read().select("org", "reference", "n").collect())) == stored and files(target) == names
    assert target.vacuum() >= 1 and target.read().count() == 10


def test_writers_that_meet(spark, table, monkeypatch):
    """Another writer commits between this one's look and its commit: once elsewhere, once on the same key."""
    bucket = {r.id: r.b for r in rows_of(spark, range(200)).select("id", table.bucket().alias("b")).collect()}
    mine = 0
    far = next(i for i in bucket if bucket[i] != bucket[mine])
    commit, work = table._commit, []
    add = lambda i, n: (spark.createDataFrame([(i,)], "id long"), lambda old: old.withColumn("owner_id", F.when(F.col("id") == i, F.col("owner_id") + n).otherwise(F.col("owner_id"))))
    for other in (far, mine):
        pending = [other]

        def late(state, pending=pending):
            if pending:
                i = pending.pop()
                monkeypatch.setattr(table, "_commit", commit)
                assert table.merge(*add(i, 100))
                monkeypatch.setattr(table, "_commit", late)
            return commit(state)

        monkeypatch.setattr(table, "_commit", late)
        keys, how = add(mine, 1)
        assert table.merge(keys, lambda old, how=how: (work.append(1), how(old))[1])
        monkeypatch.setattr(table, "_commit", commit)
    got = {r.id: r.owner_id for r in table.read().collect()}
    assert got[far] == far + 100 and got[mine] == mine + 1 + 1 + 100 and len(got) == 200
    assert len(work) == 3  # the second time it had to work again


def test_inserts_and_edges(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"], buckets=2)
    with pytest.raises(ValueError):
        t.read()
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string")
    assert t.insert_new(rows((1, "b"), (1, "a"), (None, "z")), ["v"])
    for k in range(2, 2 + 3 * FOLDERS):
        assert t.insert_new(rows((k, "n"), (1, "later")), ["v"])
    assert t.insert_new(rows(), ["v"])
    assert sorted((r.id, r.v) for r in t.read().collect()) == [(1, "a")] + [(k, "n") for k in range(2, 2 + 3 * FOLDERS)]
    assert max(len(f) for f in t.state()["folders"].values()) <= FOLDERS
