"""State machines on streams against plain replays of the same events, whatever the batches, restarts and timers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bidlake.streaming import jobs, stateful

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def replay(spark, tmp_path, schema, batches, job, name="out"):
    """Each batch comes in a run of its own, so state, timers and watermark come from the checkpoint each time."""
    source, out, checkpoint = (str(tmp_path / f"{name}-{x}") for x in ("in", "rows", "state"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        got = stateful.run_available(job(spark.readStream.schema(schema).parquet(source)), out, checkpoint)
    return sorted((tuple(r) for r in got.collect()), key=str)


# --- STR-1 ---

QUEUE = "quotation_id long, organization_id string, kind string, at timestamp"


def plain_queue(events, lease, attempts, watermark):
    """All that happens up to each key's last event, or the watermark if that is later."""
    out = []
    for key in {e[0] for e in events}:
        mine = sorted((e for e in events if e[0] == key), key=lambda e: (e[3], {"done": 0, "failed": 1, "queue": 2}[e[2]]))
        job = None  # organisation, attempt, end of the lease

        def expire(now):
            nonlocal job
            while job and job[2] <= now:
                if job[1] == attempts:
                    out.append((key, job[0], "given_up", job[1], job[2]))
                    job = None
                else:
                    out.append((key, job[0], "again", job[1] + 1, job[2]))
                    job = (job[0], job[1] + 1, job[2] + lease)

        for _, org, kind, at in mine:
            expire(at)
            if kind == "queue":
                free = job is None
                job = job or (org, 1, at + lease)
                out.append((key, org, "run" if free else "refused", job[1], at))
            elif job:
                out.append((key, job[0], kind, job[1], at))
                job = None
        expire(watermark)
    return sorted(out, key=str)


def test_queue_refuses_in_flight_and_takes_after_completion_and_timeout(spark, tmp_path):
    at = lambda h: T0 + h * HOUR
    batches = [
        [(1, "a", "queue", at(0)), (2, "a", "queue", at(0))],
        [(1, "a", "queue", at(0.5))],  # in flight: refused
        [(1, "a", "done", at(0.8)), (1, "a", "queue", at(0.9))],  # free again: taken
        [(3, "a", "queue", at(9)), (1, "a", "done", at(1))],
        [(2, "a", "queue", at(9))],  # both leases of 2 have ended: given up, so taken again
    ]
    job = lambda s: stateful.work_queue(s, lease=2 * HOUR, attempts=2, late="1 hour")
    got = replay(spark, tmp_path, QUEUE, batches, job)
    assert [(r[2], r[3], r[4]) for r in got if r[0] == 1] == sorted([("run", 1, at(0)), ("refused", 1, at(0.5)), ("done", 1, at(0.8)), ("run", 1, at(0.9)), ("done", 1, at(1))], key=str)
    assert [(r[2], r[3], r[4]) for r in got if r[0] == 2] == sorted([("run", 1, at(0)), ("again", 2, at(2)), ("given_up", 2, at(4)), ("run", 1, at(9))], key=str)
    assert [r[2] for r in got if r[0] == 3] == ["run"]


@pytest.mark.parametrize("batches", [1, 4])
def test_queue_against_replay(spark, tmp_path, batches):
    rng = random.Random(4)
    times = sorted(rng.sample(range(200_000), 240))
    events = [(rng.randrange(12), rng.choice("ab"), rng.choice(("queue", "queue", "queue", "done", "failed")), T0 + dt.timedelta(seconds=s)) for s in times]
    step = -(-len(events) // batches)
    job = lambda s: stateful.work_queue(s, lease=5 * HOUR, attempts=3, late="10 minutes")
    got = replay(spark, tmp_path, QUEUE, [events[k : k + step] for k in range(0, len(events), step)], job)
    assert got == plain_queue(events, 5 * HOUR, 3, events[-1][3] - dt.timedelta(minutes=10))


# --- STR-5 ---

ORDERS = "po_id long, organization_id string, po_number string, kind string, expected timestamp, at timestamp"


def test_one_follow_up_an_order(spark, tmp_path):
    day = lambda d: T0 + dt.timedelta(days=d)
    batches = [
        [(1, "a", "PO-1", "issued", day(3), day(0)), (2, "a", "PO-2", "issued", day(3), day(0)), (3, "a", "PO-3", "issued", day(3), day(0)), (4, "a", "PO-4", "issued", None, day(0)), (8, "a", "PO-8", "issued", day(2), day(0))],
        [(2, "a", "PO-2", "delivered", None, day(2)), (3, "a", "PO-3", "issued", day(8), day(2)), (5, "b", "PO-5", "issued", day(1), day(2.5))],  # 3 moves, 5 comes overdue
        [(6, "b", "PO-6", "issued", day(20), day(5)), (7, "b", "PO-7", "issued", day(6), day(5)), (7, "b", "PO-7", "asked", None, day(5))],  # the watermark passes day 3
        [(1, "a", "PO-1", "issued", day(7), day(6)), (8, "a", "PO-8", "delivered", None, day(6))],  # asked already: not again
        [(9, "b", "PO-9", "issued", day(40), day(30))],
    ]
    got = replay(spark, tmp_path, ORDERS, batches, lambda s: stateful.overdue_stream(s, late="1 hour"))
    assert sorted((r[0], r[3], r[5]) for r in got) == [
        (1, 0, day(3) + dt.timedelta(milliseconds=1)), (3, 0, day(8) + dt.timedelta(milliseconds=1)), (5, 1, day(2.5)),
        (6, 0, day(20) + dt.timedelta(milliseconds=1)), (8, 0, day(2) + dt.timedelta(milliseconds=1)),
    ]
    assert {r[4] for r in got if r[0] == 5} == {"Delivery status: purchase order PO-5"}
    whole = replay(spark, tmp_path, ORDERS, [[e for b in batches for e in b]], lambda s: stateful.overdue_stream(s, late="1 hour"), "whole")
    assert whole == got


# --- STR-4 ---

SOURCING = "request_id long, organization_id string, kind string, quotation_id long, status string, at timestamp"


@pytest.mark.parametrize("batches", [1, 5])
def test_autopilot(spark, tmp_path, batches):
    rng = random.Random(8)
    events = []
    for k in range(160):
        kind = rng.choice(("request", "quotation", "quotation", "quotation", "finished", "started"))
        status = rng.choice(("open", "comparing", "awarded")) if kind == "request" else rng.choice(("COMPLETED", "REQUIRES_REVIEW", "FAILED")) if kind == "quotation" else None
        events.append((rng.randrange(6), "a", kind, rng.randrange(4) if kind == "quotation" else None, status, T0 + k * HOUR))
    want, state = [], {}
    for r, org, kind, q, status, at in events:
        s = state.setdefault(r, {"status": None, "ready": set(), "active": False})
        if kind == "request":
            s["status"] = status
        elif kind != "quotation":
            s["active"] = kind == "started"
        elif status not in stateful.COMPARABLE:
            s["ready"].discard(q)
        else:
            s["ready"].add(q)
            if len(s["ready"]) >= 2 and not s["active"] and s["status"] in ("open", "comparing"):
                s["active"] = True
                want.append((r, org, len(s["ready"]), at))
    step = -(-len(events) // batches)
    got = replay(spark, tmp_path, SOURCING, [events[k : k + step] for k in range(0, len(events), step)], stateful.autopilot_stream)
    assert got == sorted(want, key=str) and len(got) > 3


# --- STR-3, STR-6 ---


def test_status_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k % 7, rng.choice("abc"), T0 + k * HOUR) for k in range(60)]
    schema = "quotation_id int, status string, at timestamp"
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.latest_status(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    stream.writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start().awaitTermination()
    want = {q: max((at, s) for k, s, at in rows if k == q) for q in range(7)}
    assert {r.quotation_id: (r.updated_at, r.status) for r in spark.table("latest").collect()} == want


def test_tenants(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "organization_id string, n int")
    seen, failed = {}, []

    def handle(part, tenant):
        if tenant == "b":
            raise ValueError("mailbox")
        seen[tenant] = sorted(r.n for r in part.collect())

    jobs.for_each_tenant(handle, report=lambda tenant, e: failed.append((tenant, str(e))))(rows, 0)
    assert seen == {"a": [1, 3], None: [4]} and failed == [("b", "mailbox")]
    for query, batch in (("first", 0), ("first", 0), ("second", 0)):  # run again, then under a new checkpoint
        jobs.write_by_tenant(str(tmp_path / "t"), query)(rows, batch)
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("organization_id").agg(F.count("*").alias("n")).where("organization_id = 'a'").first().n == 4


def test_appending_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "reference string")
    jobs.append_unseen(path)(rows("a", "b", "c"), 0)
    jobs.append_unseen(path)(rows("c", "d"), 0)  # a new checkpoint starts with batch 0 again
    jobs.append_unseen(path)(rows("c", "d"), 0)
    assert sorted(r.reference for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "d"]


def test_state_is_called_once_for_neighbours(spark, tmp_path):
    """Orders and requests of neighbouring numbers share a key of the state store."""
    base = dt.datetime(2024, 1, 1)
    rows = [(n, "1", str(n), "issued", None, base) for n in range(64)]
    events = spark.createDataFrame(rows, ORDERS)
    assert stateful._neighbours(events, "po_id").select("neighbours").distinct().count() == 2
    first = [(n, "1", str(n), "issued", base + n * HOUR, base) for n in range(40)]
    then = [(39, "1", "39", "closed", None, base + HOUR), (-1, "1", "-1", "issued", None, base + 100 * HOUR)]
    got = replay(spark, tmp_path, ORDERS, [first, then], stateful.overdue_stream, "near")
    assert sorted(r[0] for r in got) == list(range(39))  # one timer after another, up to the watermark
