"""Events of a job in their order, though they arrive in any: transitions and leases with event-time timers.

State of a slot of jobs is what each job's settled events amount to and a buffer of those that are not yet
settled. An event is settled once the watermark has passed its time, as none before it can
still count then; a timer at the earliest buffered event sees to it. So the buffer holds
no more than the delay's worth of the slot's events, and a restart goes on from the state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import NEXT

#: Takes the state, settled rows in order and the watermark in microseconds; gives the state, output rows and the next time to look again.
Fold = Callable[[Any, list[tuple], int], tuple[Any, list[tuple], int | None]]


#: Keys share the state of so many slots: a call for each key would cost far more than folding its rows. A checkpoint keeps to its number.
SLOTS = 1024


class _InOrder(StatefulProcessor):
    """Rows of a slot: the key as text, ``micros`` (event time in microseconds), then the columns that the fold takes."""

    def __init__(self, columns: list[str], output: list[str], fold: Fold) -> None:
        self._columns, self._output, self._fold = columns, output, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "state string, waiting string, timer bigint")

    def _settle(self, fresh: list[tuple], timers: Any, expired: bool) -> Iterator[pd.DataFrame]:
        held = self._held.get()
        # per key its state and the next time to look again
        states = {k: (state, wake) for k, state, wake in json.loads(held[0])} if held else {}
        waiting, timer = (json.loads(held[1]), None if expired else held[2]) if held else ([], None)
        # the watermark counts milliseconds
        now = timers.getCurrentWatermarkInMs() * 1000 + 999
        ready: dict[Any, list[tuple]] = {k: [] for k, (_, wake) in states.items() if wake is not None and wake <= now}
        rest = []
        for r in (*map(tuple, waiting), *fresh):
            if r[1] <= now:
                ready.setdefault(r[0], []).append(r[1:])
            else:
                rest.append(r)
        out: list[tuple] = []
        for key, rows in ready.items():
            state, found, wake = self._fold(states.get(key, (None, None))[0], sorted(rows), now)
            states[key] = state, wake
            out += [(key, *r) for r in found]
        times = [r[1] for r in rest] + [wake for _, wake in states.values() if wake is not None]
        due = min(times) // 1000 if times else None
        if timer is not None and timer != due:
            self._handle.deleteTimer(timer)
        if due is not None and timer != due:
            self._handle.registerTimer(due)
        self._held.update((json.dumps([(k, *x) for k, x in states.items() if x != (None, None)]), json.dumps(rest), due))
        if out:
            yield pd.DataFrame(out, columns=self._output)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = [t for f in rows for t in zip(*(f[c].tolist() for c in self._columns), strict=True)]
        yield from self._settle(fresh, timerValues, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._settle([], timerValues, True)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, columns: list[str], output: str, fold: Fold, delay: str, at: str = "ts") -> DataFrame:
    """Fold each key's events in order of time, then of ``columns``; later ones than the delay allows are dropped.

    ``output`` begins with the key. The stream needs the RocksDB state store (``streams.run_once`` sets it).
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("key_slot")
    own = events.withWatermark(at, delay).select(slot, F.col(key).cast("string").alias("key_text"), at, F.unix_micros(at).alias("micros"), *columns)
    first, rest = output.split(",", 1)
    name, kind = first.split()
    names = ["key_text", *[c.split()[0] for c in rest.split(",")]]
    folded = own.groupBy("key_slot").transformWithStateInPandas(_InOrder(["key_text", "micros", *columns], names, fold), f"key_text string,{rest}", "append", "eventTime")
    return folded.select(F.col("key_text").cast(kind).alias(name), *names[1:])


def _transitions(state: Any, rows: list[tuple], now: int) -> tuple[Any, list[tuple], int | None]:
    out = []
    for _, event_id, status, kind in rows:
        allowed = state is None or state == status or status in NEXT.get(state, []) or (state == "queued" and status == "processing" and kind == "cleanup_scene")
        if not allowed:
            out.append((event_id, state, status))
        state = status
    return state, out, None


def transition_violations(events: DataFrame, delay: str, at: str = "ts") -> DataFrame:
    """job, event_id, previous, status: events whose status may not follow the job's last one.

    Reads event_id, job, status, kind and the time, of any number of files in any order within the delay.
    """
    return in_order(events, "job", ["event_id", "status", "kind"], "job long, event_id long, previous string, status string", _transitions, delay, at)


def _leases(lease_us: int) -> Fold:
    def fold(state: Any, rows: list[tuple], now: int) -> tuple[Any, list[tuple], int | None]:
        holder, expiry = state or (None, None)
        out: list[tuple] = []
        for at, event_id, worker, kind in rows:
            if holder is not None and at >= expiry:
                out.append((None, holder, "expired", expiry))
                holder = None
            if kind == "claim" and holder is not None and holder != worker:
                out.append((event_id, worker, "refused", at))
            elif kind != "claim" and holder != worker:
                out.append((event_id, worker, "lost", at))
            elif kind == "complete":
                holder = None
            else:
                holder, expiry = worker, at + lease_us
        if holder is not None and expiry <= now - 999:
            out.append((None, holder, "expired", expiry))
            holder = None
        return (holder, expiry) if holder is not None else None, out, expiry if holder is not None else None

    return fold


def lease_watch(events: DataFrame, lease_seconds: int, delay: str, at: str = "ts") -> DataFrame:
    """task, event_id, worker, outcome, at_us: leases that ran out (without an event), claims of a held task, renewals and completions of a lost lease.

    Reads event_id, task, worker, kind (claim, renew, complete) and the time. A lease runs from its
    claim or last renewal; its holder may claim it again; a timer ends one that is not renewed.
    """
    return in_order(events, "task", ["event_id", "worker", "kind"], "task long, event_id long, worker string, outcome string, at_us long", _leases(lease_seconds * 1_000_000), delay, at)
