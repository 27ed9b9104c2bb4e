"""Keyed state driven by event time: alerts with control events, and deadlines, as streams and as windows over the log.

A stream holds events back until the watermark has passed them and then takes them in order of their time, so input
that arrives shuffled, within the watermark's delay, gives the rows of the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events of an alert, in the order that they take where their times are one: what a sweep saw, and what a person did.
EVENTS = ("BREACH", "RECOVER", "RESOLVE", "ACKNOWLEDGE")
ALERT_SCHEMA = "owner string, signal string, at timestamp, event string, status string, occurrences long, opened_at timestamp, acknowledged_at timestamp, resolved_at timestamp, accepted boolean"
DEADLINE_SCHEMA = "entity string, deadline timestamp"


def _rank(event: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, EVENTS)), event)


def controlled_alerts(events: DataFrame) -> DataFrame:
    """Alert states after every event (owner, signal, at, event) from a signal's first breach on: see alert_after().

    Acknowledging never opens or closes an alert, so whether one is open follows from the last other event, and the
    rest from the last openings, closings and acknowledgements: windows only. Events of unknown kinds are left out.
    """
    order = [F.col("at"), _rank(F.col("event"))]
    over = Window.partitionBy("owner", "signal").orderBy(*order)
    upto, past = over.rowsBetween(Window.unboundedPreceding, 0), over.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.filter(F.col("event").isin(*EVENTS)).withColumn("occurrences", F.sum((F.col("event") == "BREACH").cast("long")).over(upto)).filter("occurrences > 0")
    rows = rows.withColumn("_nth", F.row_number().over(over))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    opens = F.when(F.col("event") != "ACKNOWLEDGE", F.col("event") == "BREACH")
    rows = rows.withColumn("_opens", opens).withColumns({"_open": last(F.col("_opens"), upto), "_was": F.coalesce(last(F.col("_opens"), past), F.lit(False))})
    opened = F.when((F.col("event") == "BREACH") & ~F.col("_was"), F.struct("_nth", "at"))
    closed = F.when((F.col("event") == "RESOLVE") | (F.col("event") == "RECOVER") & F.col("_was"), F.col("at"))
    acknowledged = F.when((F.col("event") == "ACKNOWLEDGE") & F.col("_was"), F.struct("_nth", "at"))
    told = rows.withColumns({"_o": last(opened, upto), "_c": last(closed, upto), "_a": last(acknowledged, upto)})
    status = F.when(~F.col("_open"), "RESOLVED").when(F.col("event") == "ACKNOWLEDGE", "ACKNOWLEDGED").otherwise("OPEN")
    return told.select(
        "owner", "signal", "at", "event", status.alias("status"), "occurrences", F.col("_o.at").alias("opened_at"), F.when(F.col("_a._nth") > F.col("_o._nth"), F.col("_a.at")).alias("acknowledged_at"),
        F.when(~F.col("_open"), F.col("_c")).alias("resolved_at"), ((F.col("event") != "ACKNOWLEDGE") | F.col("_was")).alias("accepted"),
    )


def alert_after(state: tuple | None, at, event: str) -> tuple | None:
    """(status, occurrences, opened_at, acknowledged_at, resolved_at) after an event; None before the first breach.

    A breach opens an alert, an acknowledged one, too; after a resolution it begins a new episode, whose occurrences go
    on counting. A recovery resolves what is open, a person resolves anything. A resolved alert can't be acknowledged.
    """
    if event == "BREACH":
        if state is None or state[0] == "RESOLVED":
            return ("OPEN", 1 if state is None else state[1] + 1, at, None, None)
        return ("OPEN", state[1] + 1, *state[2:])
    if state is None or event == "RECOVER" and state[0] == "RESOLVED" or event == "ACKNOWLEDGE" and state[0] == "RESOLVED":
        return state
    if event == "ACKNOWLEDGE":
        return ("ACKNOWLEDGED", *state[1:3], at, state[4])
    return ("RESOLVED", *state[1:4], at)


class _InOrder(StatefulProcessor):
    """Holds a key's events until event time has passed them. A timer stands a millisecond behind each of them, when
    none of its time can come any more."""

    columns: tuple[str, ...] = ()
    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for row in pdf[list(self.columns)].itertuples(index=False):
                row = tuple(None if pd.isna(v) else v for v in row)
                self.held.appendValue(row)
                for at in self.times(row):
                    self.handle.registerTimer(int(at.timestamp() * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs() - 1, unit="ms")
        rows = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        due = sorted((r for r in rows if pd.Timestamp(r[0]) <= until), key=self.order)
        left = [r for r in rows if pd.Timestamp(r[0]) > until]
        self.held.clear()
        if left:
            self.held.put(left)
        yield from self.passed(key, due, until)

    def times(self, row: tuple) -> list:
        return [row[0]]

    def order(self, row: tuple) -> tuple:
        return (row[0],)

    def passed(self, key, rows: list[tuple], until: pd.Timestamp) -> Iterator[pd.DataFrame]:
        raise TypeError("a subclass says what passed events do")

    def close(self) -> None:
        pass


class ControlledAlerts(_InOrder):
    """One alert for each (owner, signal), fed by sweeps and by people: see alert_after()."""

    columns, schema = ("at", "event"), "at timestamp, event string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("alert", "status string, occurrences long, opened_at timestamp, acknowledged_at timestamp, resolved_at timestamp")

    def order(self, row: tuple) -> tuple:
        return (row[0], EVENTS.index(row[1]))

    def passed(self, key, rows: list[tuple], until: pd.Timestamp) -> Iterator[pd.DataFrame]:
        state, out = tuple(self.state.get()) if self.state.exists() else None, []
        for at, event in rows:
            accepted = event != "ACKNOWLEDGE" or state is not None and state[0] != "RESOLVED"
            state = alert_after(state, at, event)
            if state is not None:
                out.append((*key, at, event, *state, accepted))
        if state is not None:
            self.state.update(tuple(None if pd.isna(v) else v for v in state))
        if out:
            yield pd.DataFrame(out, columns=["owner", "signal", "at", "event", "status", "occurrences", "opened_at", "acknowledged_at", "resolved_at", "accepted"])


def alert_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Streaming form of controlled_alerts()."""
    rows = events.filter(F.col("event").isin(*EVENTS)).withWatermark("at", late)
    return rows.groupBy("owner", "signal").transformWithStateInPandas(ControlledAlerts(), outputStructType=ALERT_SCHEMA, outputMode="Append", timeMode="EventTime")


def passed_deadlines(events: DataFrame, now: Column) -> DataFrame:
    """(entity, deadline) of every deadline that passed before `now` while it stood, from a log (entity, at, deadline).

    An event with a deadline sets it, not before its own time, in place of an earlier one; one without takes it away.
    What comes at the very time of the deadline is in time; of events of one time those that set one come last, the
    later deadline behind.
    """
    over = Window.partitionBy("entity").orderBy("at", F.col("deadline").isNotNull(), "deadline")
    rows = events.withColumn("_next", F.lead("at").over(over)).withColumn("deadline", F.when(F.col("deadline").isNotNull(), F.greatest("deadline", "at")))
    return rows.filter((F.col("deadline") < now) & (F.col("_next").isNull() | (F.col("_next") > F.col("deadline")))).select("entity", "deadline")


class Deadlines(_InOrder):
    """The deadline of each entity as a timer that an event may move or cancel."""

    columns, schema = ("at", "deadline"), "at timestamp, deadline timestamp"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.standing = handle.getValueState("deadline", "deadline timestamp")

    def times(self, row: tuple) -> list:
        return [row[0]] if row[1] is None else [row[0], max(row[0], row[1])]

    def order(self, row: tuple) -> tuple:
        return (row[0], row[1] is not None, row[1] or row[0])

    def passed(self, key, rows: list[tuple], until: pd.Timestamp) -> Iterator[pd.DataFrame]:
        standing, out = self.standing.get()[0] if self.standing.exists() else None, []
        for at, deadline in rows:
            if standing is not None and pd.Timestamp(at) > pd.Timestamp(standing):
                out.append(standing)
            standing = None if deadline is None else max(at, deadline)
        if standing is not None and pd.Timestamp(standing) <= until:
            out.append(standing)
            standing = None
        if standing is None:
            self.standing.clear()
        else:
            self.standing.update((standing,))
        if out:
            yield pd.DataFrame({"entity": key[0], "deadline": out})


def deadline_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Streaming form of passed_deadlines(), up to where the watermark has come."""
    return events.withWatermark("at", late).groupBy("entity").transformWithStateInPandas(Deadlines(), outputStructType=DEADLINE_SCHEMA, outputMode="Append", timeMode="EventTime")
