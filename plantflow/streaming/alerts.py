"""Alerts as a keyed stream: pending, firing, reminders, resolved, with event-time timers.

Observations are (key, ts, present): whether a condition holds, null where its source failed. Pending
fires after `for_s` of presence and is dropped where the condition vanishes before. A firing
alert is repeated every `repeat_s` while it is present (0: never) and resolves after `clear_s`
of absence. What was observed holds until the next observation, so timers act between them. While
the source is stale nothing happens: no timer acts, absence neither begins nor ends. What fell
due meanwhile is settled by the next observation that is in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

US = 1_000_000
EVENTS = "key string, event string, at timestamp"


@dataclass
class Alert:
    """State of one key, in microseconds; `observed` is 1 present, 0 absent, -1 stale."""

    phase: str = ""  # '', 'pending' or 'firing'
    observed: int = -1
    first_seen: int = 0
    last_sent: int = 0
    absent_since: int = -1


@dataclass(frozen=True)
class Limits:
    for_s: float = 120
    clear_s: float = 120
    repeat_s: float = 0

    def due(self, a: Alert) -> tuple[int, str] | None:
        """Time and event of the next timer, while the observation holds."""
        if a.observed == 1 and a.phase == "pending":
            return a.first_seen + int(self.for_s * US), "firing"
        if a.observed == 1 and a.phase == "firing" and self.repeat_s > 0:
            return a.last_sent + int(self.repeat_s * US), "reminder"
        if a.observed == 0 and a.phase == "firing":
            return a.absent_since + int(self.clear_s * US), "resolved"
        return None

    def fire(self, a: Alert, at: int, event: str) -> tuple[str, int]:
        if event == "resolved":
            a.phase, a.absent_since = "", -1
        else:
            a.phase, a.last_sent = "firing", at
        return event, at

    def observe(self, a: Alert, at: int, present: bool | None) -> list[tuple[str, int]]:
        """Take an observation; what fell due while the source was stale happens now."""
        a.observed = -1 if present is None else int(present)
        if present:
            a.absent_since = -1
            if not a.phase:
                a.phase, a.first_seen = "pending", at
        elif present is not None:
            if a.phase == "pending":
                a.phase = ""
            elif a.phase and a.absent_since < 0:
                a.absent_since = at
        late = self.due(a)
        return [self.fire(a, at, late[1])] if late and late[0] <= at else []

    def advance(self, a: Alert, upto: int) -> list[tuple[str, int]]:
        """Timers that are due before `upto`."""
        found = []
        while (timer := self.due(a)) and timer[0] < upto:
            found.append(self.fire(a, *timer))
        return found


class Alerts(StatefulProcessor):
    """Keeps observations until the watermark passes them, then walks them in order of time.

    State of a key is the alert and what the watermark's delay still holds back. One timer a key
    wakes it when its next observation or its next timer is due.
    """

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", ", ".join(f"{f.name} {'string' if f.name == 'phase' else 'bigint'}" for f in fields(Alert)))
        self.waiting = handle.getListState("waiting", "ts bigint, present boolean")
        self.awake = handle.getValueState("awake", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for frame in rows:
            known = (None if pd.isna(p) else bool(p) for p in frame["present"])
            fresh += zip(frame["ts"].dt.as_unit("us").astype("int64").tolist(), known)
        yield self._settle(key, timerValues.getCurrentWatermarkInMs(), fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.awake.clear()
        yield self._settle(key, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, watermark_ms: int, fresh: list[tuple] = ()) -> pd.DataFrame:
        """Events up to the watermark, which later rows can't change any more.

        What waits is read and written as a whole, a call each, not a call a row.
        """
        horizon = watermark_ms * 1000
        stored = self.alert.get()
        alert = Alert(*stored) if stored is not None else Alert()
        # Of several observations at one time a present one counts, then an absent one.
        held = list(self.waiting.get())
        merged: dict[int, bool | None] = {}
        for at, present in [*held, *fresh]:
            merged[at] = max((p for p in (present, merged.get(at)) if p is not None), default=None)
        waiting = sorted(merged.items(), key=lambda x: x[0])
        found = []
        for at, present in waiting:
            if at >= horizon:
                break
            found += self.limits.advance(alert, at)
            found += self.limits.observe(alert, at, present)
        later = [x for x in waiting if x[0] >= horizon]
        if later and (fresh or len(later) < len(held)):
            self.waiting.put(later)
        elif held and not later:
            self.waiting.clear()
        found += self.limits.advance(alert, horizon)
        due = [at for at, _ in later][:1]
        if alert.phase:
            self.alert.update(tuple(asdict(alert).values()))
        else:  # without an alert there is nothing to remember
            self.alert.clear()
        if timer := self.limits.due(alert):
            due.append(timer[0])
        self._wake(min(due, default=None))
        at = pd.Series([t for _, t in found], dtype="int64").astype("datetime64[us]").dt.tz_localize("UTC")
        return pd.DataFrame({"key": pd.Series([key[0]] * len(found), dtype=object), "event": pd.Series([e for e, _ in found], dtype=object), "at": at})

    def _wake(self, at: int | None) -> None:
        """One timer: the first millisecond at which the watermark is past `at`."""
        now = self.awake.get()
        wanted = None if at is None else at // 1000 + 1
        if now is not None and now[0] != wanted:
            self.handle.deleteTimer(now[0])
            self.awake.clear()
        if wanted is not None and (now is None or now[0] != wanted):
            self.handle.registerTimer(wanted)
            self.awake.update((wanted,))

    def close(self) -> None:
        pass


def alert_stream(observed: DataFrame, limits: Limits = Limits(), delay_s: float = 30) -> DataFrame:
    """Stream of (key, event, at) from a stream of observations (key, ts, present), in event time.

    Rows later than `delay_s` behind the newest are dropped by the watermark. Needs the RocksDB state store.
    """
    rows = observed.select("key", "ts", "present").where("key is not null and ts is not null").withWatermark("ts", f"{delay_s} seconds")
    return rows.groupBy("key").transformWithStateInPandas(Alerts(limits), EVENTS, "append", "EventTime")


STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def walk(observations: list[tuple], limits: Limits, horizon) -> list[tuple[str, object]]:
    """The same over one key's observations (ts, present) at once: events before `horizon`; tests compare with it."""
    alert, found = Alert(), []
    epoch = type(horizon)(1970, 1, 1)
    us = lambda t: (t - epoch) // timedelta(microseconds=1)
    for at, present in sorted(observations):
        if at >= horizon:
            break
        found += limits.advance(alert, us(at)) + limits.observe(alert, us(at), present)
    return [(e, epoch + timedelta(microseconds=t)) for e, t in found + limits.advance(alert, us(horizon))]
