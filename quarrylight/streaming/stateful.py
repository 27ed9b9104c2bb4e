"""Streaming operators and the batch folds that give the same rows over a replayed log.

Reference timers and queues become keyed state over an event log: side effects stay outside, the result is the log of
states. Event time takes the place of processing time throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RETRY_CAP, MOST_ATTEMPTS = 300, 5


def distinct_events(events: DataFrame, keys: list[str], time: str | None = None, horizon: str | None = None) -> DataFrame:
    """Replay-safe dedupe. Without a horizon the state is unbounded; with one, duplicates later than it may pass."""
    if horizon is None:
        return events.dropDuplicates(keys)
    return events.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def minute_counts(events: DataFrame, owner: str, time: str, late: str = "10 minutes") -> DataFrame:
    """(owner, minute, n) by event time; a minute is final once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(owner, F.window(time, "1 minute").alias("w")).agg(F.count("*").alias("n")).select(owner, F.col("w.start").alias("minute"), "n")


def rolling_counts(events: DataFrame, owner: str, time: str, width: str = "24 hours", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(owner, F.window(time, width, step).alias("w")).agg(F.count("*").alias("n")).select(owner, F.col("w.start").alias("start"), "n")


def monthly_usage(events: DataFrame, owner: str, time: str, amount: str) -> DataFrame:
    """Totals by calendar month, for update mode; negative amounts count as 0."""
    return events.groupBy(owner, F.date_format(time, "yyyy-MM").alias("period")).agg(F.sum(F.greatest(F.lit(0), F.col(amount))).alias("used"))


def backoff(attempts: int) -> int:
    """Seconds until an outbox event is tried again."""
    return min(RETRY_CAP, 2**attempts)


def task_backoff(retries: int) -> int:
    return min(10 * 3**retries, RETRY_CAP)


ALERT_SCHEMA = "owner string, signal string, at timestamp, status string, occurrences long, opened_at timestamp, resolved_at timestamp"


def alert_step(state: tuple | None, at: pd.Timestamp, broken: bool) -> tuple | None:
    """(status, occurrences, opened_at, resolved_at) after a sweep; None before the first breach.

    A breach opens or reopens the alert, also an acknowledged one; recovery resolves it. A breach after a resolution
    starts a new episode, whose occurrences go on counting.
    """
    if broken:
        if state is None:
            return ("OPEN", 1, at, None)
        return ("OPEN", state[1] + 1, at if state[0] == "RESOLVED" else state[2], None)
    if state is not None and state[0] in ("OPEN", "ACKNOWLEDGED"):
        return ("RESOLVED", state[1], state[2], at)
    return state


def alert_log(sweeps: DataFrame) -> DataFrame:
    """Alert states after every sweep (owner, signal, at, broken) in window functions: the batch form of AlertProcessor.

    A row for each sweep from a signal's first breach on.
    """
    over = Window.partitionBy("owner", "signal").orderBy("at")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    placed = sweeps.withColumn("was", F.coalesce(F.lag("broken").over(over), F.lit(False)))
    opened = F.max(F.when(F.col("broken") & ~F.col("was"), F.col("at"))).over(upto)
    closed = F.max(F.when(~F.col("broken") & F.col("was"), F.col("at"))).over(upto)
    n = F.sum(F.col("broken").cast("long")).over(upto)
    rows = placed.withColumns({"occurrences": n, "opened_at": opened, "_closed": closed}).filter("occurrences > 0")
    status = F.when(F.col("broken"), "OPEN").otherwise("RESOLVED")
    return rows.select("owner", "signal", "at", status.alias("status"), "occurrences", "opened_at", F.when(~F.col("broken"), F.col("_closed")).alias("resolved_at"))


class AlertProcessor(StatefulProcessor):
    """One alert for each (owner, signal): see alert_step. Emits the state after every sweep from the first breach on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", "status string, occurrences long, opened_at timestamp, resolved_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("at")
        state, out = tuple(self.state.get()) if self.state.exists() else None, []
        for at, broken in zip(pdf["at"], pdf["broken"]):
            state = alert_step(state, at, bool(broken))
            if state is not None:
                out.append((*key, at, *state))
        if state is not None:
            self.state.update(tuple(None if v is None or v is pd.NaT else v for v in state))
        yield pd.DataFrame(out, columns=["owner", "signal", "at", "status", "occurrences", "opened_at", "resolved_at"])

    def close(self) -> None:
        pass


def alert_stream(sweeps: DataFrame) -> DataFrame:
    """Streaming form of alert_log: keyed state, one micro-batch of sweeps at a time."""
    return sweeps.groupBy("owner", "signal").transformWithStateInPandas(AlertProcessor(), outputStructType=ALERT_SCHEMA, outputMode="Append", timeMode="None")


def notifications(log: DataFrame) -> DataFrame:
    """One row for each episode of an alert."""
    return log.filter("status = 'OPEN'").dropDuplicates(["owner", "signal", "opened_at"]).select("owner", "signal", "opened_at")


def outbox_log(attempts: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Outbox states from an attempt log (event, at, outcome of ok, error or blocked): adds attempt, status, available_at.

    An error makes the event PENDING again after its back-off, or FAILED at the last attempt; what comes after a final
    status is ignored.
    """
    over = Window.partitionBy("event").orderBy("at")
    placed = attempts.withColumn("attempt", F.row_number().over(over))
    status = F.when(F.col("outcome") == "ok", "COMPLETED").when(F.col("outcome") == "blocked", "BLOCKED").when(F.col("attempt") >= most, "FAILED").otherwise("PENDING")
    rows = placed.withColumn("status", status)
    done = F.max((F.col("status") != "PENDING").cast("int")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    wait = F.least(F.lit(RETRY_CAP), F.pow(F.lit(2), F.col("attempt"))).cast("int")
    kept = rows.withColumn("_done", F.coalesce(done, F.lit(0))).filter("_done = 0")
    return kept.withColumn("available_at", F.when(F.col("status") == "PENDING", F.col("at") + F.make_interval(secs=wait))).drop("_done")


def task_log(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Task states from an attempt log (task, at, ok): RETRYING with a growing delay until `most` attempts, then FAILED."""
    over = Window.partitionBy("task").orderBy("at")
    placed = attempts.withColumn("attempt", F.row_number().over(over))
    status = F.when(F.col("ok"), "COMPLETED").when(F.col("attempt") >= most, "FAILED").otherwise("RETRYING")
    delay = F.least(F.lit(RETRY_CAP), 10 * F.pow(F.lit(3), F.col("attempt") - 1)).cast("int")
    return placed.withColumns({"status": status, "delay": F.when(status == "RETRYING", delay)})


def outbox_step(attempts: int, at: pd.Timestamp, outcome: str, most: int = MOST_ATTEMPTS) -> tuple[int, str, pd.Timestamp | None]:
    """(attempts, status, available_at) after another attempt at an outbox event: see outbox_log()."""
    attempts += 1
    if outcome == "ok":
        return attempts, "COMPLETED", None
    if outcome == "blocked":
        return attempts, "BLOCKED", None
    if attempts >= most:
        return attempts, "FAILED", None
    return attempts, "PENDING", at + pd.Timedelta(seconds=backoff(attempts))


def task_step(attempts: int, ok: bool, most: int = 3) -> tuple[int, str, int | None]:
    """(attempts, status, delay) after another attempt at a task: see task_log()."""
    attempts += 1
    if ok:
        return attempts, "COMPLETED", None
    return (attempts, "FAILED", None) if attempts >= most else (attempts, "RETRYING", task_backoff(attempts - 1))


class _Attempts(StatefulProcessor):
    """Keeps the number of attempts at a key and whether its status is final; where that `stops` it, later rows are ignored."""

    stops = True

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("attempts", "attempts int, final boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("at")
        attempts, final = tuple(self.state.get()) if self.state.exists() else (0, False)
        out = []
        for row in pdf.itertuples(index=False):
            if final and self.stops:
                break
            attempts, status, then = self.step(attempts, row)
            final = status not in ("PENDING", "RETRYING")
            out.append((key[0], row.at, attempts, status, then))
        self.state.update((attempts, final))
        yield pd.DataFrame(out, columns=[self.key, "at", "attempt", "status", self.then])

    def close(self) -> None:
        pass


class OutboxProcessor(_Attempts):
    key, then = "event", "available_at"

    def step(self, attempts: int, row) -> tuple:
        return outbox_step(attempts, row.at, row.outcome)


class TaskProcessor(_Attempts):
    key, then, stops = "task", "delay", False

    def step(self, attempts: int, row) -> tuple:
        return task_step(attempts, bool(row.ok))


def outbox_stream(attempts: DataFrame) -> DataFrame:
    """Streaming form of outbox_log over (event string, at, outcome): keyed state, one micro-batch at a time."""
    kinds = "event string, at timestamp, attempt int, status string, available_at timestamp"
    return attempts.groupBy("event").transformWithStateInPandas(OutboxProcessor(), outputStructType=kinds, outputMode="Append", timeMode="None")


def task_stream(attempts: DataFrame) -> DataFrame:
    """Streaming form of task_log over (task string, at, ok)."""
    kinds = "task string, at timestamp, attempt int, status string, delay int"
    return attempts.groupBy("task").transformWithStateInPandas(TaskProcessor(), outputStructType=kinds, outputMode="Append", timeMode="None")


def dead_letters(log: DataFrame) -> DataFrame:
    """What a task or outbox log has given up: its FAILED and BLOCKED rows."""
    return log.filter(F.col("status").isin("FAILED", "BLOCKED"))


def connector_rows(pushed: DataFrame, now: str) -> DataFrame:
    """Rows that a connector may ingest: consent given, and each (connector, source_ref) once, however often it is sent."""
    return distinct_events(consented(pushed, "consent", now), ["connector", "source_ref"])


def step_latency(steps: DataFrame) -> DataFrame:
    """(step, n, mean_ms): a worker's append-only step log (step, started, ended), for update mode."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    took = (micros("ended") - micros("started")) / 1000
    return steps.groupBy("step").agg(F.count("*").alias("n"), F.round(F.avg(took), 3).alias("mean_ms"))


def consented(rows: DataFrame, consent: str, now: str) -> DataFrame:
    """Connector rows whose consent was given, and not in the future."""
    return rows.filter(F.col(consent).isNotNull() & (F.col(consent) <= F.lit(now).cast("timestamp")))


def webhook_rows(raw: DataFrame, value: str = "value") -> DataFrame:
    """(provider, external_id, type, body) of JSON webhooks: the type in lower case, the id from the first field that has one."""
    field = lambda name: F.get_json_object(value, f"$.{name}")
    given = F.coalesce(field("id"), field("event_id"), field("data.id"), F.concat(F.lit("sha256:"), F.sha2(value, 256)))
    return raw.select(field("provider").alias("provider"), given.alias("external_id"), F.lower(F.coalesce(field("type"), field("event"), F.lit("unknown"))).alias("type"), F.col(value).alias("body"))
