"""State machines per key on event streams: the work queue, the overdue watch and the autopilot (STR-1, STR-4, STR-5).

Each runs in ``transformWithState``: state and timers are kept by key in the state store and survive a
restart with the checkpoint, and no store is read again for each batch. What happens depends on event times alone: before
an event is handled, whatever fell due before it is, so any cut of the stream into batches gives the same
rows. Events of a key that come after later ones of an earlier batch count in the order in which they come.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Fixed values.
COMPARABLE = ("COMPLETED", "REQUIRES_REVIEW")
CLOSED_REQUESTS = ("awarded", "closed", "cancelled")
#: How many neighbouring numbers of orders or requests share a key of the state store: calls to it cost more than the work on an order.
NEIGHBOURS = 32
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def use_state_store(spark: SparkSession) -> None:
    """The state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def millis(t: dt.datetime) -> int:
    return ((t if t.tzinfo else t.replace(tzinfo=dt.UTC)) - EPOCH) // dt.timedelta(milliseconds=1)


def moment(ms: int) -> dt.datetime:
    return EPOCH + dt.timedelta(milliseconds=ms)


def in_order(rows: Iterator[Row], ranks: dict[str, int]) -> list[Row]:
    """A key's events of one batch by time; of one time, by the rank of their kind."""
    return sorted(rows, key=lambda r: (r.at, ranks.get(r.kind, len(ranks))))


class WorkQueue(StatefulProcessor):
    """One key's job: none, or in flight with a lease that ends at a time."""

    OUT = "quotation_id long, organization_id string, action string, attempt int, at timestamp"
    RANKS = {"done": 0, "failed": 1, "queue": 2}

    def __init__(self, lease_ms: int, attempts: int):
        self.lease_ms, self.attempts = lease_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "organization_id string, attempt int, ends long")

    def _held(self) -> tuple | None:
        return tuple(self.job.get()) if self.job.exists() else None

    def _store(self, before: tuple | None, after: tuple | None) -> None:
        if before == after:
            return
        if before is not None:
            self.handle.deleteTimer(before[2])
        if after is None:
            self.job.clear()
        else:
            self.job.update(after)
            self.handle.registerTimer(after[2])

    def _expire(self, key, job: tuple | None, now: int, out: list[Row]) -> tuple | None:
        """Leases that ended by ``now``: the job runs again, or is given up after the last attempt."""
        while job is not None and job[2] <= now:
            org, attempt, ends = job
            over = attempt >= self.attempts
            out.append(Row(quotation_id=key[0], organization_id=org, action="given_up" if over else "again", attempt=attempt if over else attempt + 1, at=moment(ends)))
            job = None if over else (org, attempt + 1, ends + self.lease_ms)
        return job

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = job = self._held()
        out: list[Row] = []
        for r in in_order(rows, self.RANKS):
            job = self._expire(key, job, millis(r.at), out)
            if r.kind == "queue":
                free = job is None
                if free:
                    job = (r.organization_id, 1, millis(r.at) + self.lease_ms)
                out.append(Row(quotation_id=key[0], organization_id=r.organization_id, action="run" if free else "refused", attempt=job[1], at=r.at))
            elif job is not None:
                out.append(Row(quotation_id=key[0], organization_id=job[0], action=r.kind, attempt=job[1], at=r.at))
                job = None
        self._store(before, job)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self._held()
        out: list[Row] = []
        self._store(before, self._expire(key, before, timerValues.getCurrentWatermarkInMs(), out))
        return iter(out)


def by(rows: Iterator[Row], name: str) -> dict[int, list[Row]]:
    """The events of neighbours, apart."""
    out: dict[int, list[Row]] = {}
    for r in rows:
        out.setdefault(r[name], []).append(r)
    return out


class OverdueWatch(StatefulProcessor):
    """Neighbouring purchase orders: open with an expected time, or asked about already; closed orders hold no state. One timer waits for
    the earliest expected time among them."""

    OUT = "po_id long, organization_id string, po_number string, days_late int, subject string, at timestamp"
    RANKS = {"issued": 0, "asked": 1, "delivered": 2, "closed": 2, "cancelled": 2}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.orders = handle.getValueState("orders", "held array<struct<po_id: long, organization_id: string, po_number: string, expected: long, due: long, asked: boolean>>")

    def _held(self) -> dict[int, tuple]:
        held = self.orders.get()
        return {x[0]: tuple(x)[1:] for x in held[0]} if held is not None else {}

    def _ask(self, po_id, order: tuple | None, now: int, out: list[Row]) -> tuple | None:
        if order is None or order[4] or order[3] is None or order[3] > now:
            return order
        org, number, expected, due, _ = order
        late = (moment(due).date() - moment(expected).date()).days
        out.append(Row(po_id=po_id, organization_id=org, po_number=number, days_late=late, subject=f"Delivery status: purchase order {number}", at=moment(due)))
        return (org, number, expected, due, True)

    def _store(self, before: dict[int, tuple], after: dict[int, tuple]) -> None:
        waits = lambda held: min((x[2] for x in held.values() if x[2] is not None and not x[4]), default=None)
        if before == after:
            return
        old, new = waits(before), waits(after)
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if not after:
            self.orders.clear()
            return
        self.orders.update(([(k, *x) for k, x in after.items()],))
        if new is not None and old != new:
            self.handle.registerTimer(new)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self._held()
        after, out = dict(before), []
        for po_id, events in by(rows, "po_id").items():
            order = self._after(po_id, after.pop(po_id, None), events, out)
            if order is not None:
                after[po_id] = order
        self._store(before, after)
        return iter(out)

    def _after(self, po_id, order: tuple | None, events: list[Row], out: list[Row]) -> tuple | None:
        for r in in_order(events, self.RANKS):
            order = self._ask(po_id, order, millis(r.at), out)
            if r.kind == "issued":  # a later one moves the expected time; who was asked is not asked again
                expected = millis(r.expected) if r.expected is not None else None
                due = max(expected + 1, millis(r.at)) if expected is not None else None
                order = (r.organization_id, r.po_number, expected, due, order is not None and order[4])
                order = self._ask(po_id, order, millis(r.at), out)
            elif r.kind == "asked":
                order = (*order[:4], True) if order is not None else (r.organization_id, r.po_number, None, None, True)
            elif r.kind in self.RANKS:
                order = None
        return order

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before, out = self._held(), []
        now = timerValues.getCurrentWatermarkInMs()
        self._store(before, {k: self._ask(k, x, now, out) for k, x in before.items()})
        return iter(out)


class Autopilot(StatefulProcessor):
    """Neighbouring requests: of each its status, its comparable quotations and whether a run is under way."""

    OUT = "request_id long, organization_id string, quotations int, at timestamp"
    RANKS = {"request": 0, "finished": 1, "quotation": 2, "started": 3}

    def __init__(self, least: int):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.requests = handle.getValueState("requests", "held array<struct<request_id: long, organization_id: string, status: string, active: boolean, ready: array<long>>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.requests.get()
        before = {x[0]: (x[1], x[2], x[3], list(x[4])) for x in held[0]} if held is not None else {}
        after, out = dict(before), []
        for request_id, events in by(rows, "request_id").items():
            after[request_id] = self._after(request_id, before.get(request_id, (None, None, False, [])), events, out)
        if after != before:
            self.requests.update(([(k, *x) for k, x in after.items()],))
        return iter(out)

    def _after(self, request_id, request: tuple, events: list[Row], out: list[Row]) -> tuple:
        org, status, active, ready = request
        comparable = dict.fromkeys(ready)  # quotations in the order in which they became comparable
        for r in in_order(events, self.RANKS):
            if r.kind == "request":
                org, status = r.organization_id, r.status
            elif r.kind in ("started", "finished"):
                active = r.kind == "started"
            elif r.kind == "quotation" and r.status not in COMPARABLE:
                comparable.pop(r.quotation_id, None)
            elif r.kind == "quotation":
                comparable[r.quotation_id] = None
                if len(comparable) >= self.least and not active and status is not None and status not in CLOSED_REQUESTS:
                    active = True
                    out.append(Row(request_id=request_id, organization_id=org, quotations=len(comparable), at=r.at))
        return (org, status, active, list(comparable))


def _neighbours(events: DataFrame, number: str) -> DataFrame:
    return events.withColumn("neighbours", F.floor(F.col(number) / NEIGHBOURS))


def work_queue(events: DataFrame, lease: dt.timedelta = dt.timedelta(hours=1), attempts: int = 3, late: str = "10 minutes") -> DataFrame:
    """STR-1: what happens to jobs. ``events``: quotation_id, organization_id, kind, at; kinds ``queue``, ``done`` and ``failed``.

    A queued quotation runs unless it is in flight, then the request is ``refused``; ``done`` and ``failed`` release it. A job whose lease
    ends without either (its worker died) runs ``again``, and after the last attempt is ``given_up`` and released. Append mode."""
    keyed = events.select("quotation_id", "organization_id", "kind", "at").withWatermark("at", late).groupBy("quotation_id")
    return keyed.transformWithState(WorkQueue(lease // dt.timedelta(milliseconds=1), attempts), WorkQueue.OUT, "Append", "EventTime")


def overdue_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """STR-5: one follow-up per order, when its expected time passes. ``events``: po_id, organization_id, po_number, kind, expected, at;
    kinds ``issued`` (again with another expected time moves it), ``delivered``, ``closed``, ``cancelled`` (no follow-up
    any more) and ``asked`` (someone else wrote already). An order that is overdue when it comes is asked about at once."""
    keyed = events.select("po_id", "organization_id", "po_number", "kind", "expected", "at").withWatermark("at", late)
    keyed = _neighbours(keyed, "po_id").groupBy("neighbours")
    return keyed.transformWithState(OverdueWatch(), OverdueWatch.OUT, "Append", "EventTime")


def autopilot_stream(events: DataFrame, least: int = 2) -> DataFrame:
    """STR-4: runs to start. ``events``: request_id, organization_id, kind, quotation_id, status, at; kinds ``quotation`` and ``request`` with
    their status, ``started`` and ``finished`` for runs. A quotation that becomes comparable starts a run if the request
    is known and open, has ``least`` comparable quotations and no run under way. Append mode."""
    keyed = _neighbours(events.select("request_id", "organization_id", "kind", "quotation_id", "status", "at"), "request_id").groupBy("neighbours")
    return keyed.transformWithState(Autopilot(least), Autopilot.OUT, "Append", "None")


def run_available(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs an append stream over what is there, writes its rows to ``folder`` and reads them."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
