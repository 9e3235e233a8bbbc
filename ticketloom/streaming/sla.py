"""SLA alerts from two streams: opened and resolved tickets, with event-time timers per open ticket."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ticketloom.functions import normalize as N
from ticketloom.streaming import jobs

#: Part of the allowed time after which an open ticket is at risk.
AT_RISK_SHARE = 0.75
AT_RISK, BREACH = "at_risk", "breach"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of tickets by the hash of their id. A group's open tickets are one value of the state, so that what a batch costs
#: beside its rows is a few calls per group instead of several per ticket.
GROUPS = 4096


class SlaTimers(StatefulProcessor):
    """State of a group: of each ticket when it is at risk and due while that is still to come, and when it was resolved if
    that was heard first. A ticket is gone once it is resolved or has missed its deadline. The group has one timer, at the
    first of these times."""

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        times = "array<bigint>"
        self.held = handle.getValueState(
            "tickets", f"ids array<{self.kind}>, risk {times}, due {times}, resolved {times}, timer bigint"
        )

    def _open(self) -> tuple[dict, int | None]:
        """The group's tickets as id to (risk, due, resolved), and its timer."""
        if not self.held.exists():
            return {}, None
        ids, risk, due, resolved, timer = self.held.get()
        return dict(zip(ids, zip(risk, due, resolved))), timer

    def _keep(self, tickets: dict, timer: int | None) -> None:
        """Stores the group; ``timer`` is the one still registered."""
        first = min((at for times in tickets.values() for at in times if at is not None), default=None)
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if tickets:
            risk, due, resolved = (list(c) for c in zip(*tickets.values()))
            self.held.update((list(tickets), risk, due, resolved, first))
        elif timer is not None:
            self.held.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        tickets, timer = self._open()
        known = {i for i, (_, due, _) in tickets.items() if due is not None}
        heard = set()
        for row in rows:
            i = row["ticket_id"]
            risk, due, resolved = tickets.get(i, (None, None, None))
            if row["due_ms"] is None:
                resolved = row["at_ms"] if resolved is None else min(resolved, row["at_ms"])
            elif i not in known and (due is None or row["due_ms"] < due):
                risk, due = row["risk_ms"], row["due_ms"]
            tickets[i] = risk, due, resolved
            heard.add(i)
        for i in heard:
            risk, due, resolved = tickets[i]
            if due is not None and resolved is not None:
                for alert, at in ((AT_RISK, risk), (BREACH, due)):
                    if at is not None and at < resolved:  # it was still open then
                        yield Row(ticket_id=i, alert=alert, at_ms=at)
                del tickets[i]
        self._keep(tickets, timer)  # a resolution without a ticket is forgotten in time

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tickets, timer = self._open()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if fired != timer:
            return
        passed = max(fired, timerValues.getCurrentWatermarkInMs())
        for i, (risk, due, resolved) in list(tickets.items()):
            if risk is not None and risk <= passed:
                yield Row(ticket_id=i, alert=AT_RISK, at_ms=risk)
                tickets[i] = None, due, None
            if due is not None and due <= passed:
                yield Row(ticket_id=i, alert=BREACH, at_ms=due)
                del tickets[i]
            elif due is None and resolved <= passed:
                del tickets[i]
        self._keep(tickets, timer)

    def close(self) -> None:
        pass


def events(tickets: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One stream (ticket_id, at, at_ms, risk_ms, due_ms) of opened tickets (ticket_id, priority, created_at) and of
    resolutions (ticket_id, resolved_at), which have no deadline. Rows without an id or a time are left out."""
    hours = N.sla_hours(F.col("priority"))
    opened = F.unix_millis(F.col("created_at").cast("timestamp"))
    allowed = hours.cast("long") * 3_600_000
    first = tickets.select(
        "ticket_id", F.col("created_at").cast("timestamp").alias("at"), opened.alias("at_ms"),
        (opened + F.floor(allowed * AT_RISK_SHARE)).cast("long").alias("risk_ms"), (opened + allowed).alias("due_ms"),
    )
    resolved = F.col("resolved_at").cast("timestamp")
    none = F.lit(None).cast("long")
    second = resolutions.select(
        "ticket_id", resolved.alias("at"), F.unix_millis(resolved).alias("at_ms"), none.alias("risk_ms"), none.alias("due_ms")
    )
    return first.unionByName(second).where(F.col("ticket_id").isNotNull() & F.col("at").isNotNull())


@contextmanager
def rocks_db(spark: SparkSession):
    """Keeps state in RocksDB, which timers need, for streams started inside."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def alerts(tickets: DataFrame, resolutions: DataFrame, watermark: str = jobs.WATERMARK) -> DataFrame:
    """(ticket_id, alert, at): one at-risk and one breach row per ticket that was open at that time.

    A ticket that is resolved before or at the time cancels the alert. Alerts of a ticket without a resolution come when
    the watermark passes their time; those of a ticket resolved later come with its resolution at the latest. A resolution
    may be heard before its ticket. Of a ticket opened twice the earlier deadline counts. Tickets are shuffled by the hash of
    their id, in GROUPS groups; the state holds three numbers per open ticket.
    """
    kind = tickets.schema["ticket_id"].dataType.simpleString()
    heard = events(tickets, resolutions).withWatermark("at", watermark)
    group = F.pmod(F.xxhash64("ticket_id"), F.lit(GROUPS)).cast("int")
    found = heard.withColumn("_group", group).groupBy("_group").transformWithState(
        SlaTimers(kind), f"ticket_id {kind}, alert string, at_ms long", "Append", "EventTime"
    )
    return found.select("ticket_id", "alert", F.timestamp_millis("at_ms").alias("at"))


def run_alerts(tickets: DataFrame, resolutions: DataFrame, root: str, progress: str, watermark: str = jobs.WATERMARK) -> DataFrame:
    """Works through what has arrived and returns the alerts written so far below ``root``; a run with the same two
    folders goes on where the last one ended."""
    spark = tickets.sparkSession
    found = alerts(tickets, resolutions, watermark)
    with rocks_db(spark):
        found.writeStream.outputMode("append").option("checkpointLocation", progress).trigger(availableNow=True).format(
            "parquet"
        ).option("path", root).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(root)
