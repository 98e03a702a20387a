"""Streaming forms of sampling, idle detection, change detection and log routing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType, TimestampType

from fleetlens.fixed import GAUGE_PREFIX
from fleetlens.operators.events import route, route_history
from fleetlens.operators.metrics import gauge_lines, sample
from fleetlens.operators.sessions import last_states


def sample_stream(
    gauges: DataFrame,
    every: str = "5 minutes",
    delay: str = "10 minutes",
    ts: str = "sampled_at",
    tie: str = "sample_id",
) -> DataFrame:
    """Last value per metric and interval, emitted once the watermark passes its end."""
    timed = gauges.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return sample(timed, every, ts=ts, tie=tie)


def write_gauge_stream(
    gauges: DataFrame,
    path: str,
    checkpoint: str,
    prefix: str = GAUGE_PREFIX,
    unit_col: str | None = None,
    **trigger: str | bool,
) -> StreamingQuery:
    """Start writing gauge lines as text files; ``trigger`` is that of ``writeStream``."""
    writer = gauge_lines(gauges, prefix, unit_col).writeStream.format("text")
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.option("path", path).option("checkpointLocation", checkpoint).start()


def idle_stream(activity: DataFrame, gap_s: int, delay: str = "1 minute") -> DataFrame:
    """Users whose activity went quiet for ``gap_s`` while idle in a transaction.

    A run is emitted once the watermark passes its end, so runs still open at the
    last watermark stay in state.
    """
    timed = activity.withColumn("state_change", F.col("state_change").cast("timestamp"))
    return last_states(timed.withWatermark("state_change", delay), gap_s)


def route_stream(lines: DataFrame, routes: DataFrame) -> DataFrame:
    """Stream of log lines against a static route table."""
    return route(lines, routes)


def route_history_stream(lines: DataFrame, routes: DataFrame, longest: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """``route_history`` of a stream of lines and a stream of routes, as each comes in, in any order.

    Lines and routes may be ``delay`` behind the newest of their kind. A route is kept until
    no line within ``longest`` of its start can come, a line until no route that holds at its
    time can, so the state doesn't grow with the streams' age.
    """
    timed = lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    known = routes.withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to")})
    return route_history(timed, known.withWatermark("valid_from", delay), longest)


class _LastValue(StatefulProcessor):
    """Keeps each key's last value in the engine's state, and says where a row differs from it."""

    def __init__(self, columns: Sequence[str], state: StructType) -> None:
        self.columns, self.state = columns, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        known = self.last.get()  # a row with the value, or none
        before = known[0] if known is not None else None
        for row in in_order(rows, 1, 2):
            value = row[3]
            if known is None or value != before:
                yield Row(**dict(zip(self.columns, [*row, before], strict=True)))
            known, before = (value,), value
        self.last.update((before,))

    def close(self) -> None:
        pass


def in_order(rows: Iterable[Row], *places: int) -> list[Row]:
    """Rows by the values in those places, nulls first, as Spark sorts them."""
    return sorted(rows, key=lambda row: [(row[i] is not None, row[i]) if row[i] is not None else (False,) for i in places])


def change_stream(stream: DataFrame, key: str, value: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``changes`` for a stream: rows whose ``value`` differs from the one before it for the key.

    The engine keeps the last value of each key in its state store, with its own
    checkpoints, so a trigger reads and writes only the keys that it has rows of, and one
    that is run again gives each change once. Inside a trigger a key's rows are taken in
    the order of ``ts`` and ``tie``, nulls first; between triggers the order is arrival. A
    null value is a value, a null key a key. A key's rows of one trigger are sorted in one
    task, so bound the trigger by the source's limits.
    """
    slim = stream.select(key, ts, tie, value)
    fields = list(slim.schema.fields)
    state = StructType([StructField("value", slim.schema[value].dataType)])
    out = StructType([*[StructField(f.name, f.dataType) for f in fields], StructField("previous", fields[3].dataType)])
    processor = _LastValue(out.names, state)
    return slim.groupBy(key).transformWithState(processor, out, outputMode="Append", timeMode="None")


class _Settled(StatefulProcessor):
    """The sample before, and until when a unit may take to come to rest."""

    def __init__(self, limit_ms: int, columns: Sequence[str]) -> None:
        self.limit_ms, self.columns = limit_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "position string, started bigint, done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        known = self.seen.get()
        before, started, done = tuple(known) if known is not None else (None, None, False)
        for row in in_order(rows, 1, 2):
            if done or row[1] is None:
                continue
            if started is None:
                started = round(row[1].timestamp() * 1000)
                self.handle.registerTimer(started + self.limit_ms)
            if row[3] is not None and row[3] == before:
                done = True
                self.handle.deleteTimer(started + self.limit_ms)
                yield Row(**dict(zip(self.columns, (row[0], row[3], row[1], True), strict=True)))
            before = row[3]
        self.seen.update((before, started, done))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        position, started, done = tuple(self.seen.get())
        if not done:
            self.seen.update((position, started, True))
            yield Row(**dict(zip(self.columns, (key[0], None, None, False), strict=True)))

    def close(self) -> None:
        pass


def settled_stream(
    samples: DataFrame, limit_s: int, delay: str = "1 minute", key: str = "unit", ts: str = "ts", tie: str = "sample_id"
) -> DataFrame:
    """``settled`` as it happens: ``(unit, position, settled_at, settled)``, one row per unit.

    A unit settles with the first sample whose known position is that of the sample before
    it. If none has by the time that the watermark passes ``limit_s`` seconds after its
    first sample, a row without position says that it did not settle; samples that come
    after that, or after the unit has settled, change nothing. Samples without a time are
    passed over. Inside a trigger samples are taken by ``ts`` and ``tie``.
    """
    timed = samples.select(key, F.col(ts).cast("timestamp").alias(ts), tie, "position").withWatermark(ts, delay)
    out = StructType(
        [timed.schema[key], timed.schema["position"], StructField("settled_at", TimestampType()), StructField("settled", BooleanType())]
    )
    processor = _Settled(limit_s * 1000, out.names)
    return timed.groupBy(key).transformWithState(processor, out, outputMode="Append", timeMode="EventTime")
