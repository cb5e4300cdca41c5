"""Site health: a keyed state machine over runs, as a stream with event-time timers and as a batch fold of the same steps.

Streams: runs wait in state until the watermark has passed them, so they are folded in order of time however they arrive; rows
later than the watermark are dropped by Spark. One timer per site stands at its earliest waiting run, its re-activation
or its expiry; between timers a site costs nothing. Batches: rows are dealt by site, sorted within tasks and folded from an
iterator, so that no site is ever held whole, however many runs it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ventura.session import ship

DAY = 86_400_000_000
STATE = "status string, failures int, runs long, successes long, next_at long, exclude_until long, diagnoses int, last_at long"
#: A site without a run for so long is forgotten; a later run is its first.
KEEP = 730 * DAY
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Health:
    """What is known of one site; times are microseconds."""

    status: str = "pending"
    failures: int = 0
    runs: int = 0
    successes: int = 0
    next_at: int = 0
    exclude_until: int = 0
    diagnoses: int = 0
    last_at: int = 0

    def step(self, at: int, result: str) -> None:
        """One run: success heals for a week; no records degrade for two days; an error breaks for a day, a third failure
        in a row excludes for 90 days, and the second asks for one diagnosis. A site excluded until a time before the run
        is pending again first."""
        self.reactivate(at)
        self.runs, self.last_at = self.runs + 1, at
        if result == "success":
            self.status, self.failures, self.next_at = "healthy", 0, at + 7 * DAY
            self.successes += 1
            return
        self.failures += 1
        self.status, self.next_at = ("degraded", at + 2 * DAY) if result == "zero_result" else ("broken", at + DAY)
        self.diagnoses += self.failures == 2
        if self.failures >= 3:
            self.status, self.exclude_until = "excluded", at + 90 * DAY
            self.next_at = self.exclude_until

    def reactivate(self, at: int) -> bool:
        """A site whose exclusion is over is pending and due at once."""
        if self.status != "excluded" or self.exclude_until > at:
            return False
        self.status, self.failures, self.next_at = "pending", 0, self.exclude_until
        return True


def after(state: Health, at: int, result: str, keep: int = KEEP) -> Health:
    """The state after one more run."""
    own = Health() if state.runs and at - state.last_at >= keep else replace(state)
    own.step(at, result)
    return own


def keyed(runs: DataFrame) -> DataFrame:
    """site, event_id, finished_at (the event time of a stream), at (microseconds), status."""
    at = F.col("finished_at").cast("timestamp")
    return runs.select("site", "event_id", at.alias("finished_at"), F.unix_micros(at).alias("at"), "status")


def batch_health(runs: DataFrame, keep: int = KEEP) -> DataFrame:
    """State of each site after all its runs, in order of time, then event_id. Null sites are one site; null times come first."""
    ship(runs.sparkSession)
    names = ["site", *Health.__annotations__]
    kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, site, state = [], None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
        for batch in batches:
            for key, at, result in zip(*(batch.column(c).to_pylist() for c in ("site", "at", "status"))):
                if state is None or key != site:
                    if state:
                        done.append((site, *astuple(state)))
                    site, state = key, Health()
                state = after(state, at or 0, result, keep)
            if done:
                yield made()
                done.clear()
        if state:
            done.append((site, *astuple(state)))
            yield made()

    rows = keyed(runs).select(F.col("site").cast("long").alias("site"), "event_id", "at", "status")
    ordered = rows.repartition("site").sortWithinPartitions("site", "at", "event_id")
    return ordered.select("site", "at", "status").mapInArrow(run, f"site long, {STATE}")


class InOrder(StatefulProcessor):
    """Holds each key's rows until the watermark has passed them and hands them on in order of (at, event_id).

    Subclasses say what to do with rows whose time has come, and when else to be called.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, event_id long", "status string")
        self.alarm = handle.getValueState("alarm", "at long")

    def _ring(self, at: int) -> None:
        """One timer a key, at the earliest time asked for (milliseconds, rounded up)."""
        at = -(-at // 1000)
        if self.alarm.exists():
            (set_for,) = self.alarm.get()
            if set_for <= at:
                return
            self.handle.deleteTimer(set_for)
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        for r in rows:
            self.waiting.updateValue((r["at"], r["event_id"]), (r["status"],))
            first = r["at"] if first is None else min(first, r["at"])
        if first is not None:
            self._ring(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if self.alarm.exists() and self.alarm.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.alarm.clear()
        come, first = [], None
        for (at, event_id), (status,) in self.waiting.iterator():
            if at <= now:
                come.append((at, event_id, status))
            else:
                first = at if first is None else min(first, at)
        come.sort()
        for at, event_id, _ in come:
            self.waiting.removeKey((at, event_id))
        out = list(self.advance(key, come, now))
        for at in (first, self.next_call()):
            if at is not None:
                self._ring(max(at, now + 1000))
        return iter(out)

    def advance(self, key: tuple, rows: list[tuple[int, int, str]], now: int) -> Iterator[Row]:
        raise NotImplementedError

    def next_call(self) -> int | None:
        """Time of the next call that no row asks for."""
        return None

    def close(self) -> None:
        pass


class SiteHealth(InOrder):
    """An updated row per site whenever runs were folded or a timer re-activated it. State goes ``keep`` after the last run."""

    def __init__(self, keep: int = KEEP):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.health = handle.getValueState("health", STATE)

    def advance(self, key: tuple, rows: list[tuple[int, int, str]], now: int) -> Iterator[Row]:
        own = Health(*self.health.get()) if self.health.exists() else Health()
        for at, _, result in rows:
            own = after(own, at, result, self.keep)
        changed = own.reactivate(now) or bool(rows)
        if own.last_at + self.keep <= now:
            self.health.clear()
        else:
            self.health.update(astuple(own))
        if changed:
            yield Row(site=key[0], **dict(zip(Health.__annotations__, astuple(own))), as_of=now)

    def next_call(self) -> int | None:
        if not self.health.exists():
            return None
        own = Health(*self.health.get())
        return min(own.exclude_until, own.last_at + self.keep) if own.status == "excluded" else own.last_at + self.keep


class StatusChanges(InOrder):
    """A row for each run whose status is another than the site's run before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "status string")

    def advance(self, key: tuple, rows: list[tuple[int, int, str]], now: int) -> Iterator[Row]:
        before = self.last.get()[0] if self.last.exists() else None
        for _, event_id, status in rows:
            if before is not None and status != before:
                yield Row(site=key[0], event_id=event_id, before=before, status=status)
            before = status
        if rows:
            self.last.update((before,))


def _stateful(runs: DataFrame, late: str) -> DataFrame:
    spark = runs.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the one that has timers
    return keyed(runs).withWatermark("finished_at", late)


def stream_health(runs: DataFrame, late: str = "1 day", keep: int = KEEP) -> DataFrame:
    """Streaming counterpart of ``batch_health``: updated rows per site, ``as_of`` being the watermark they hold for."""
    rows = _stateful(runs, late).groupBy("site")
    return rows.transformWithState(SiteHealth(keep), f"site long, {STATE}, as_of long", "Update", "eventTime")


def stream_changes(runs: DataFrame, late: str = "1 day") -> DataFrame:
    """site, event_id, before, status of each change of a site's status; runs delivered again within the watermark count once."""
    rows = _stateful(runs, late).dropDuplicatesWithinWatermark(["event_id"]).groupBy("site")
    return rows.transformWithState(StatusChanges(), "site long, event_id long, before string, status string", "Append", "eventTime")


def reactivate(health: DataFrame, as_of: int) -> DataFrame:
    """Excluded sites whose time is over become pending and due since then."""
    over = (F.col("status") == "excluded") & (F.col("exclude_until") <= as_of)
    return health.withColumn("next_at", F.when(over, F.col("exclude_until")).otherwise(F.col("next_at"))).withColumn("failures", F.when(over, 0).otherwise(F.col("failures"))).withColumn("status", F.when(over, "pending").otherwise(F.col("status")))


def due(health: DataFrame, as_of: int) -> DataFrame:
    return health.filter((F.col("status") != "excluded") & (F.col("next_at").isNull() | (F.col("next_at") <= as_of)))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts per tumbling window and type; works on batches and streams (watermarked)."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str) -> DataFrame:
    """Drive a stream over the files there are and return what the memory sink holds."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
