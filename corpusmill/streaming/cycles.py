"""Keyed cycles in event time: a work queue with leases, retries and dead letters, and a cache of requests already answered.

State and its timers live in the state store, a key's alone: what happens to a key depends on its own events, in the order
of their times within a batch and of batches. Deadlines are looked at when an event comes, so results don't hang on when a
timer fires; timers tell of deadlines that pass without an event, and free what they leave.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession, tasks: int | None = None) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which states with timers need, in ``tasks`` parts: each part
    costs a store and a Python worker a batch, whether it has keys or not."""
    own = {PROVIDER: ROCKS} | ({"spark.sql.shuffle.partitions": str(tasks)} if tasks else {})
    was = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """A batch's events of a key by time, then by id."""
    parts = list(rows)
    if parts:
        yield from pd.concat(parts).sort_values(["at", "event_id"]).itertuples(index=False)


def seconds(at: pd.Timestamp) -> float:
    return at.timestamp()


# --- queue -----------------------------------------------------------------------------
#: Seconds of a lease, tries before a task is given up, the longest wait for the next one.
LEASE, TRIES, LONGEST_WAIT = 300.0, 3, 3600.0
DONE = ("succeeded", "dead_letter", "cancelled")


class Task:
    """One task's state: status, tries so far, when its lease ends, when it may be tried again (0: not set)."""

    def __init__(self, status: str = "", attempts: int = 0, lease_until: float = 0.0, next_retry: float = 0.0, lease: float = LEASE, tries: int = TRIES, unit: float = 1.0):
        self.status, self.attempts, self.lease_until, self.next_retry = status, attempts, lease_until, next_retry
        self.lease, self.tries, self.unit = lease, tries, unit

    def recover(self, now: float) -> bool:
        """A lease that ended without a result gives the task back."""
        if self.status == "processing" and self.lease_until <= now:
            self.status, self.lease_until = "pending", 0.0
            return True
        return False

    def take(self, op: str, now: float) -> str:
        """Apply an event; what came of it."""
        self.recover(now)
        if op == "enqueue":
            if self.status and self.status not in DONE:
                return "known"
            self.status, self.attempts, self.next_retry = "pending", 0, now
            return "enqueued"
        if op == "claim":
            if self.status != "pending":
                return "not_pending"
            if self.next_retry > now:
                return "not_due"
            self.status, self.lease_until = "processing", now + self.lease
            return "claimed"
        if op == "cancel":
            if not self.status or self.status in DONE:
                return "lost"
            self.status, self.lease_until = "cancelled", 0.0
            return "cancelled"
        if self.status != "processing":
            return "lost"
        self.lease_until = 0.0
        if op == "succeed":
            self.status = "succeeded"
            return "succeeded"
        self.attempts += 1
        if self.attempts >= self.tries:
            self.status = "dead_letter"
            return "dead_letter"
        self.status, self.next_retry = "pending", now + self.unit * min(LONGEST_WAIT, 2.0 ** (self.attempts - 1))
        return "retry"


QUEUE_ROWS = "task_id long, event_id long, at timestamp, outcome string, status string, attempts int"


#: Tasks' states lie together in so many groups: a call of Python and of the state store for each task and batch costs far more than its events.
GROUPS = 1024


class QueueProcessor(StatefulProcessor):
    """The tasks of one group, read and written as a whole. Each has its next deadline, the end of its lease or the time of its next try; the group has a
    timer for the first of them."""

    def __init__(self, lease: float, tries: int, unit: float):
        self.rules = {"lease": lease, "tries": tries, "unit": unit}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tasks", "held string, timer long")

    def load(self) -> tuple[dict, int | None]:
        """(tasks, timer): each task with its deadline in milliseconds, if that was not told yet."""
        held = self.state.get()
        return ({}, None) if held is None else ({who: (Task(*state, **self.rules), due) for who, *state, due in json.loads(held[0])}, held[1])

    def save(self, held: dict, timer: int | None) -> None:
        """``timer``: the one that is set."""
        first = min((due for _, due in held.values() if due is not None), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        rows = [(who, t.status, t.attempts, t.lease_until, t.next_retry, due) for who, (t, due) in held.items()]
        self.state.update((json.dumps(rows), first))

    def deadline(self, task: Task) -> int | None:
        end = task.lease_until if task.status == "processing" else task.next_retry if task.status == "pending" and task.attempts else None
        return None if end is None else int(-(-end * 1000 // 1))

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(None if who is None else int(who), *rest) for who, *rest in rows], columns=[c.split()[0] for c in QUEUE_ROWS.split(", ")])
        return out.astype({"task_id": "Int64", "event_id": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (held, timer), out, before = self.load(), [], {}
        for e in in_order(rows):
            task, due = held.get(e.who) or (Task(**self.rules), None)
            if e.who not in before:
                before[e.who] = self.deadline(task)
                held[e.who] = task, due
            outcome = task.take(e.op, seconds(e.at))
            out.append((e.who, e.event_id, e.at, outcome, task.status, task.attempts))
        for who, was in before.items():
            if (now := self.deadline(held[who][0])) != was:
                held[who] = held[who][0], now
        self.save(held, timer)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (held, _), out = self.load(), []
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        for who, (task, due) in sorted(held.items(), key=lambda x: x[1][1] or 0):
            if due is not None and due <= now:
                outcome = "recovered" if task.recover(due / 1000) else "due" if task.status == "pending" else ""
                held[who] = task, None
                if outcome:
                    out.append((who, None, pd.Timestamp(due, unit="ms"), outcome, task.status, task.attempts))
        self.save(held, None)
        yield self.frame(out)

    def close(self) -> None:
        pass


def queue(events: DataFrame, lease: float = LEASE, tries: int = TRIES, unit: float = 1.0) -> DataFrame:
    """What each event of ``events`` (task_id, event_id, at, op; watermarked) did to its task: enqueue, claim, succeed, fail, cancel.
    Rows without ``event_id`` tell of leases that ended (recovered) and tries that came due. A cancelled task stays so."""
    dealt = events.select(F.pmod(F.xxhash64("task_id"), F.lit(GROUPS)).alias("at_once"), F.col("task_id").cast("string").alias("who"), "event_id", "at", "op")
    return dealt.groupBy("at_once").transformWithStateInPandas(QueueProcessor(lease, tries, unit), QUEUE_ROWS, "Update", "EventTime")


# --- requests --------------------------------------------------------------------------
#: Seconds that a request is remembered, requests that one cache holds.
TTL, SIZE = 300.0, 256
CACHE_ROWS = "cache long, event_id long, request_id long, at timestamp, outcome string, result string"


class CacheProcessor(StatefulProcessor):
    """One cache: the time at which each request began, and its result once it is done. It is read and written as a whole, once a
    batch, and has one timer, for its oldest request."""

    def __init__(self, ttl: float, size: int):
        self.ttl, self.size = ttl, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("requests", "request_id long, began double, done boolean, result string")

    def load(self) -> Held:
        return Held({r[0]: tuple(r[1:]) for r in self.state.get()})

    def save(self, held: Held) -> None:
        if held:
            self.state.put([(request, *value) for request, value in held.items()])
        else:
            self.state.clear()

    def due(self, began: float) -> int:
        return int(began * 1000 + self.ttl * 1000) + 1

    def deadline(self, held: Held) -> int | None:
        return self.due(held[held.oldest()][0]) if held else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.load(), []
        before = self.deadline(held)
        for e in in_order(rows):
            out.append((key[0], e.event_id, e.request_id, e.at, *answer(held, e.request_id, e.op, e.result, seconds(e.at), self.ttl, self.size)))
        self.save(held)
        after = self.deadline(held)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CACHE_ROWS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        held = Held({request: value for request, value in self.load().items() if self.due(value[0]) > now})
        self.save(held)
        if held:
            self.handle.registerTimer(self.deadline(held))
        yield pd.DataFrame(columns=[c.split()[0] for c in CACHE_ROWS.split(", ")])

    def close(self) -> None:
        pass


class Held(dict):
    """Requests by id, with the oldest at hand: a heap of (began, request), whose entries count while the request has that beginning."""

    def __init__(self, rows: dict[int, tuple] | None = None):
        super().__init__(rows or {})
        self.order = [(began, request) for request, (began, _, _) in self.items()]
        heapify(self.order)

    def __setitem__(self, request: int, value: tuple) -> None:
        if request not in self or self[request][0] != value[0]:
            heappush(self.order, (value[0], request))
        super().__setitem__(request, value)

    def oldest(self) -> int:
        while (head := self.order[0])[1] not in self or self[head[1]][0] != head[0]:
            heappop(self.order)
        return head[1]


def oldest(held: dict[int, tuple]) -> int:
    """The request that began first, then the smaller id; a plain dict is looked through."""
    return held.oldest() if isinstance(held, Held) else min(held, key=lambda r: (held[r][0], r))


def answer(held: dict[int, tuple], request: int, op: str, result: str | None, now: float, ttl: float, size: int) -> tuple[str, str | None]:
    """(outcome, result) of an event, and its effect on ``held``. begin: run (the asker has to do it), pending (another does) or
    replay (with the result); commit keeps the time of the beginning; abandon frees the request, so that it can be tried again."""
    if request in held and now - held[request][0] > ttl:
        del held[request]
    if op == "begin":
        if request in held:
            _, done, known = held[request]
            return ("replay", known) if done else ("pending", None)
        if len(held) >= size:
            del held[oldest(held)]
        held[request] = (now, False, None)
        return "run", None
    if op == "commit":
        held[request] = (held[request][0] if request in held else now, True, result)
        return "done", result
    held.pop(request, None)
    return "free", None


def request_cache(events: DataFrame, ttl: float = TTL, size: int = SIZE) -> DataFrame:
    """What each event of ``events`` (cache, event_id, request_id, at, op, result; watermarked) met in its cache. The caller deals
    requests to caches, say by a hash; a cache holds at most ``size`` requests, the oldest goes first."""
    return events.groupBy("cache").transformWithStateInPandas(CacheProcessor(ttl, size), CACHE_ROWS, "Update", "EventTime")
