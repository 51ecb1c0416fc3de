"""Folds along time: what a key's next row means depends on what was decided at its earlier rows.

Each function takes a static or a streaming DataFrame. Rows with a null key or time take no part. Times are epoch seconds.

A static table is dealt by key, sorted, and walked batch by batch, so a key of any length needs the memory of one batch.
A stream keeps each key's state in Spark's state store. With `late` (as "1 hour"), rows wait there until the watermark has
passed them, so they are walked in the order of their times whatever batches they came in; rows later than that are
dropped. What happens by itself (a cooldown that ends, a lease that runs out, a key that has been idle for long) is a
timer on event time in the stream; on a table it happens before the key's next row, or at its end if `until` has been
reached. This needs the store that keeps timers: set spark.sql.streaming.stateStore.providerClass to ROCKSDB. Without
`late`, a stream's rows are walked at once, in the order they have within a micro-batch, and nothing happens between rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.expr import classify_result, error_signature
from .chains import throttle_chain

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Fold:
    """step(state, row): the rows that a row gives, its first value being its time. due(state): when something happens by
    itself, or None; tick(state, time): the rows that this gives, after which due must have moved on. idle_s: after so
    long without a row a key's state is forgotten."""

    step: Callable[[dict, tuple], list[tuple]]
    due: Callable[[dict], int | None] = lambda state: None
    tick: Callable[[dict, int], list[tuple]] = lambda state, at: []
    idle_s: int | None = None

    def ends(self, state: dict) -> int | None:
        return None if self.idle_s is None or "last" not in state else state["last"] + self.idle_s

    def upto(self, state: dict, time: float) -> list[tuple]:
        """What happens by itself until a time, that included; a key is idle once more than idle_s have passed."""
        found, ends = [], self.ends(state)
        while (at := self.due(state)) is not None and at <= time and (ends is None or at <= ends):
            found += self.tick(state, at)
        if ends is not None and ends < time:
            state.clear()
        return found

    def row(self, state: dict, row: tuple) -> list[tuple]:
        found = self.upto(state, row[0]) + self.step(state, row)
        if self.idle_s is not None:
            state["last"] = int(row[0])
        return found


class _Keyed(StatefulProcessor):
    """One key of a stream: the rows that wait for the watermark, and the fold's state."""

    def __init__(self, fold: Fold, row: StructType, names: list[str], by: list[str]):
        self.fold, self.schema, self.names, self.by = fold, row, names, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.memo = handle.getValueState("memo", "memo string")

    def _wake(self, rows: list[tuple], state: dict) -> None:
        """The one timer that a key has: its earliest waiting row, what happens by itself, or the end of its state."""
        ends = self.fold.ends(state)
        times = [r[0] for r in rows] + [t for t in (self.fold.due(state), ends if ends is None else ends + 1) if t is not None]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if times:
            self.handle.registerTimer(1000 * int(min(times)))

    def _state(self) -> dict:
        return json.loads(self.memo.get()[0]) if self.memo.exists() else {}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for batch in rows for r in batch[self.schema.names].itertuples(index=False, name=None)]
        self.waiting.appendList([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in new])
        self._wake(list(self.waiting.get()), self._state())
        yield pd.DataFrame([], columns=self.names)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: tuple(map(_last_none, r[: len(self.by)])))
        state, found = self._state(), []
        ready = [r for r in rows if r[0] <= passed]
        for r in ready:
            found += self.fold.row(state, r)
        found += self.fold.upto(state, passed)
        if rest := rows[len(ready) :]:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if state:
            self.memo.update((json.dumps(state),))
        else:
            self.memo.clear()
        self._wake(rest, state)
        yield pd.DataFrame([(key[0], *x) for x in found], columns=self.names)

    def close(self) -> None:
        pass


def _last_none(x: object) -> tuple:
    return (x is None or x != x, x)


def _fold(df: DataFrame, order: int, fold: Fold, out: str, until: int | None = None, late: str | None = None) -> DataFrame:
    """Rows that the fold gives along each key (the first column), in the order of the `order` columns after it, the first of
    which is the time."""
    names = [c.split()[0] for c in out.split(",")]
    key, by = df.columns[0], df.columns[1 : 1 + order]
    rows = df.where(" and ".join(f"{c} is not null" for c in (key, by[0])))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, {}
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False, name=None):
                if row[0] != last:
                    if last is not None and until is not None:
                        found += [(last, *x) for x in fold.upto(state, until)]
                    last, state = row[0], {}
                found += [(last, *x) for x in fold.row(state, row[1:])]
            yield pd.DataFrame(found, columns=names)
        if last is not None and until is not None:
            yield pd.DataFrame([(last, *x) for x in fold.upto(state, until)], columns=names)

    def resume(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        found = []
        for row in pd.concat(batches).sort_values(by).itertuples(index=False, name=None):
            found += [(group[0], *x) for x in fold.row(state, row[1:])]
        held.update((json.dumps(state),))
        yield pd.DataFrame(found, columns=names)

    if not df.isStreaming:
        return rows.repartition(key).sortWithinPartitions(key, *by).mapInPandas(walk, out)
    if late is None:
        return rows.groupBy(key).applyInPandasWithState(resume, out, "memo string", "append", GroupStateTimeout.NoTimeout)
    if df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"a stream's timers need spark.sql.streaming.stateStore.providerClass = {ROCKSDB}")
    held = _Keyed(fold, StructType(rows.schema.fields[1:]), names, by)
    timed = rows.withColumn("watermarked_at", F.timestamp_seconds(by[0])).withWatermark("watermarked_at", late)
    return timed.groupBy(key).transformWithStateInPandas(held, out, "append", "eventTime")


def throttle(events: DataFrame, key: str, min_gap_s: int, count: str | None = None, snoozed_until: str | None = None, late: str | None = None) -> DataFrame:
    """(key, ts, seq) of the events shown: a key's first one, then each that comes min_gap_s or more after the last shown.

    With `count`, an event must also count more than the last shown; before its `snoozed_until` an event is never shown.
    A table without `count` takes joins alone (see throttle_chain), so one key may hold all rows; with it, and on a
    stream, events are walked in their order.
    """
    if snoozed_until:
        events = events.where(F.col("ts") >= F.coalesce(F.col(snoozed_until), F.lit(-(2**60))))
    rows = events.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("long").alias("ts"), F.col("seq").cast("long").alias("seq"), (F.coalesce(F.col(count), F.lit(0)) if count else F.lit(0)).cast("long").alias("n"))
    if count is None and not events.isStreaming:
        return throttle_chain(rows, min_gap_s).withColumnRenamed("key", key)

    def step(state: dict, row: tuple) -> list[tuple]:
        ts, seq, n = row
        if "at" in state and not (n > state["n"] and ts - state["at"] >= min_gap_s):
            return []
        state.update(at=int(ts), n=int(n) if count else -1)
        return [(ts, seq)]

    return _fold(rows, 2, Fold(step), "key string, ts long, seq long", late=late).withColumnRenamed("key", key)


def storm_cycles(results: DataFrame, by: str = "runner_id", run: int = 3, window: int = 20, least: int = 5, cooldown_s: int = 120, longest_s: int = 1800, idle_s: int | None = None, until: int | None = None, late: str | None = None, half_open: bool = False) -> DataFrame:
    """Every change of a key's breaker: opened, reopened, closed, with the failure's signature and the cooldown from then on.

    It opens as in failure_storms. When the cooldown ends it is half open, by itself, and the first result from then on is
    the probe: a success closes the breaker and forgets the window, a failure opens it again for twice as long, up to
    longest_s. Results that come during a cooldown change nothing but the window. With `half_open`, that moment is a row
    too (half_open, with a null seq).
    """

    def due(state: dict) -> int | None:
        return state["opened"] + state["wait"] if "opened" in state and not state["half"] else None

    def tick(state: dict, at: int) -> list[tuple]:
        state["half"] = True
        return [(at, None, "half_open", state["why"], state["wait"])] if half_open else []

    def step(state: dict, row: tuple) -> list[tuple]:
        ts, seq, kind, sig = row
        past = state.setdefault("past", [])
        past.append(None if kind == "ok" else sig)
        del past[:-window]
        state["hard"] = state.get("hard", 0) + 1 if kind == "permanent" else 0
        if "opened" in state:
            if not state["half"]:
                return []
            if kind == "ok":
                state.clear()
                return [(ts, seq, "closed", None, cooldown_s)]
            state.update(opened=int(ts), wait=min(2 * state["wait"], longest_s), half=False, why=sig)
            return [(ts, seq, "reopened", sig, state["wait"])]
        failed = [s for s in past if s is not None]
        top = max(sorted(set(failed)), key=failed.count, default=None)
        wide = len(past) >= least and failed and 2 * len(failed) >= len(past) and 5 * failed.count(top) >= 4 * len(failed)
        if state["hard"] < run and not wide:
            return []
        state.update(opened=int(ts), wait=cooldown_s, half=False, why=sig if state["hard"] >= run else top)
        return [(ts, seq, "opened", state["why"], cooldown_s)]

    rows = results.select(F.col(by).cast("string").alias("key"), F.col("ts").cast("long").alias("ts"), F.col("seq").cast("long").alias("seq"), classify_result(F.col("status"), F.col("error")).alias("kind"), error_signature(F.col("error")).alias("sig"))
    return _fold(rows, 2, Fold(step, due, tick, idle_s), "key string, ts long, seq long, change string, error string, cooldown_s long", until, late).withColumnRenamed("key", by)


def stream_ledger(events: DataFrame, max_retries: int = 3, lease_s: int | None = None, idle_s: int | None = None, until: int | None = None, late: str | None = None) -> DataFrame:
    """An item's state after each of its events (item_id, ts, seq, status, error), as apply_results has it at the end.

    A `lease` holds the item and adds 1 to its attempts; other statuses are those of results. Items begin with no attempts.
    With lease_s, a lease without another event for so long runs out by itself (seq is null): the item is pending again.
    """

    def due(state: dict) -> int | None:
        return state.get("until")

    def tick(state: dict, at: int) -> list[tuple]:
        del state["until"]
        return [(at, None, "pending", state["n"], state.get("error"))]

    def step(state: dict, row: tuple) -> list[tuple]:
        ts, seq, status, error = row
        n, again = state.get("n", 0), error == "timeout" == state.get("error")
        state.pop("until", None)
        if status == "lease":
            state["n"] = n + 1
            if lease_s is not None:
                state["until"] = int(ts) + lease_s
            return [(ts, seq, "leased", n + 1, state.get("error"))]
        if status in ("ok", "skipped"):
            now, error = "done", None
        elif status == "requeue":
            now, n, error = "pending", max(n - 1, 0), None
        elif again:
            now, error = "failed", "quarantined: second timeout"
        else:
            now, error = "failed" if n > max_retries else "pending", error and error[:2000]
        state.update(n=n, error=error)
        return [(ts, seq, now, n, error)]

    rows = events.select(F.col("item_id").cast("string"), F.col("ts").cast("long").alias("ts"), F.col("seq").cast("long").alias("seq"), "status", "error")
    return _fold(rows, 2, Fold(step, due, tick, idle_s), "item_id string, ts long, seq long, state string, attempts int, error string", until, late)


def alert_events(samples: DataFrame, key: str, sustain_s: int, again_s: int = 300, idle_s: int | None = None, until: int | None = None, late: str | None = None) -> DataFrame:
    """fire when the boolean `on` has held for sustain_s, refire while it goes on, again_s after the last; resolve when it ends.

    With idle_s, an alert whose samples have stopped for so long resolves by itself, and the key is forgotten. A null `on` counts as false. Only a condition that fired resolves. Of samples of one key at one time, false ones come first.
    """

    def due(state: dict) -> int | None:
        return state["last"] + idle_s if "shown" in state and idle_s is not None else None

    def tick(state: dict, at: int) -> list[tuple]:
        state.clear()
        return [(at, "resolve")]

    def step(state: dict, row: tuple) -> list[tuple]:
        ts, on = row
        if not on:
            shown = "shown" in state
            state.clear()
            return [(ts, "resolve")] if shown else []
        if ts - state.setdefault("since", int(ts)) < sustain_s or ("shown" in state and ts - state["shown"] < again_s):
            return []
        event = "refire" if "shown" in state else "fire"
        state["shown"] = int(ts)
        return [(ts, event)]

    rows = samples.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("long").alias("ts"), F.coalesce("on", F.lit(False)).alias("on"))
    return _fold(rows, 2, Fold(step, due, tick, idle_s), "key string, ts long, event string", until, late).withColumnRenamed("key", key)
