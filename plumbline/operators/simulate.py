"""Discrete-event simulators of leaking resources, one parameter cell at a time.

A cell is a row of parameters; every cell restarts from its seed, so cells are
independent and Spark runs them in parallel. State is a heap of release
times and a queue of waiters. Draws come in a fixed order: error, leak, jitter.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.prng import Mulberry

#: Defaults of a cell; a case names what differs.
DEFAULTS: dict[str, object] = {
    "kind": "pool", "seed": 42, "duration": 30_000.0, "interval": 10.0, "burst": 1, "burst_interval": 0.0, "limit": 20, "hold": 50.0, "jitter": 10.0,
    "timeout": 500.0, "leak": 0.0, "error": 0.0, "leak_on_error": False, "keep_alive": False, "heap_limit": 512 * 1024 * 1024.0, "item_bytes": 0.0,
    "stream_type": "read", "timer_type": "interval", "timer_interval": 1000.0, "timer_lifetime": 5000.0, "emitters": 1, "per_component": 1, "emit_hz": 10.0,
    "listener_type": "on", "max_listeners": 10, "latency_limit": -1.0, "rate": 10.0,
}

RESULT = (
    "exhausted_at double, succeeded double, failed double, failure_rate double, mean_latency double, p95_latency double, peak double, leaked double, "
    "total double, throughput double, heap_growth double, callbacks double"
)


def arrival_times(duration: float, step: float, each: int = 1) -> Iterator[float]:
    t = 0.0
    while t < duration:
        for _ in range(each):
            yield t
        t += step


class Holder:
    """Resources of a limited number: some are released at a time, leaked ones never."""

    def __init__(self, cell: dict, hold_extra: float = 0.0, linger: float = 0.0):
        self.c, self.draw = cell, Mulberry(int(cell["seed"]))
        self.extra, self.linger = hold_extra, linger
        self.releases: list[float] = []
        self.leaked = self.peak = self.failed = 0
        self.latencies: list[float] = []
        self.exhausted: float | None = None

    @property
    def active(self) -> int:
        return len(self.releases) + self.leaked

    def release(self, now: float) -> None:
        while self.releases and self.releases[0] <= now:
            heapq.heappop(self.releases)

    def acquire(self, arrived: float, now: float) -> None:
        c = self.c
        error, leak = self.draw() < c["error"], self.draw() < c["leak"]
        took = max(1.0, c["hold"] + (self.draw() - 0.5) * 2 * c["jitter"] + self.extra)
        if error:
            self.failed += 1
        else:
            self.latencies.append(now + took - arrived)
        if leak or error and c["leak_on_error"]:
            self.leaked += 1
        else:
            heapq.heappush(self.releases, now + 1 if error else now + took + self.linger)
        self.peak = max(self.peak, self.active)

    def mark_full(self, now: float) -> None:
        if self.exhausted is None and self.active >= self.c["limit"]:
            self.exhausted = now

    def result(self, heap: float = 0.0) -> dict:
        n, ok = len(self.latencies) + self.failed, sorted(self.latencies)
        return {
            "exhausted_at": self.exhausted, "succeeded": len(ok), "failed": self.failed, "failure_rate": self.failed / n if n else 0.0,
            "mean_latency": sum(ok) / len(ok) if ok else 0.0, "p95_latency": ok[int(len(ok) * 0.95)] if ok else 0.0, "peak": self.peak, "leaked": self.leaked,
            "total": n, "throughput": len(ok) / (self.c["duration"] / 1000), "heap_growth": heap, "callbacks": None,
        }


def queued(cell: dict, hold_extra: float = 0.0, linger: float = 0.0) -> dict:
    """Connections and sockets: who finds the limit reached waits in line until a timeout."""
    h, line = Holder(cell, hold_extra, linger), deque()

    def turn(now: float) -> None:
        while line and h.active < cell["limit"]:
            arrived = line.popleft()
            h.acquire(arrived, now)
            h.mark_full(now)

    def expire(now: float) -> None:
        while line and line[0] + cell["timeout"] <= now:
            line.popleft()
            h.failed += 1

    bursts = cell["burst"] > 1 and cell["burst_interval"] > 0
    for now in arrival_times(cell["duration"], cell["burst_interval"] if bursts else cell["interval"], int(cell["burst"]) if bursts else 1):
        h.release(now)
        expire(now)
        if h.active < cell["limit"]:
            h.acquire(now, now)
            h.mark_full(now)
        else:
            line.append(now)
        turn(now)
    h.release(cell["duration"])
    expire(cell["duration"])
    turn(cell["duration"])
    h.failed += len(line)
    return h.result()


def rejected(cell: dict) -> dict:
    """File descriptors: who finds the limit reached fails at once; a leak keeps the file's bytes."""
    h = Holder(cell)
    for now in arrival_times(cell["duration"], cell["interval"]):
        h.release(now)
        if h.active < cell["limit"]:
            h.acquire(now, now)
            h.mark_full(now)
        else:
            h.failed += 1
    return h.result(h.leaked * cell["item_bytes"])


def footprint(file_bytes: float, stream_type: str) -> float:
    """Bytes that a leaked stream holds: read buffers of 64 KB, write buffers of 16 KB, transforms both."""
    read, write = min(file_bytes, 65536), min(file_bytes, 16384)
    return {"read": read, "write": write}.get(stream_type, read + write)


def streams(cell: dict) -> dict:
    """Streams: the descriptor limit or the heap, whichever is met first by an arrival."""
    h, each = Holder(cell), footprint(cell["item_bytes"], cell["stream_type"])
    for now in arrival_times(cell["duration"], cell["interval"]):
        h.release(now)
        if h.active >= cell["limit"] or h.leaked * each >= cell["heap_limit"]:
            h.exhausted = now if h.exhausted is None else h.exhausted
            h.failed += 1
        else:
            h.acquire(now, now)
    return h.result(h.leaked * each)


def created(cell: dict, made: int, failed: int, latency: float, tail: float, peak: int, leaked: int, exhausted, callbacks: int) -> dict:
    """Result of creation-rate runs. Rejected attempts are no part of `made`, yet are taken from it: successes may be negative."""
    return {
        "exhausted_at": exhausted, "succeeded": made - failed, "failed": failed, "failure_rate": failed / made if made else 0.0, "mean_latency": latency,
        "p95_latency": latency * tail, "peak": peak, "leaked": leaked, "total": made, "throughput": (made - failed) / (cell["duration"] / 1000),
        "heap_growth": leaked * cell["item_bytes"], "callbacks": callbacks,
    }


def rounded(x: float) -> int:
    return int(x + 0.5)


def timers(cell: dict) -> dict:
    """Timers: leaked closures fill the heap; intervals fire to the end. latency_limit >= 0: a full heap or late loop ends creation for good."""
    draw, interval = Mulberry(int(cell["seed"])), cell["timer_type"] == "interval"
    leaked = made = failed = calls = 0
    exhausted, latest = None, 0.0
    strict, end, period = cell["latency_limit"] >= 0, cell["duration"], cell["timer_interval"]
    for now in arrival_times(end, max(1, rounded(1000 / cell["rate"]))):
        late = min(250.0, leaked * (1000 / period) * 0.01) if interval and period > 0 else 0.0
        latest = max(latest, late)
        full = leaked * cell["item_bytes"] >= cell["heap_limit"]
        if exhausted is None and (full or strict and late >= cell["latency_limit"]):
            exhausted = now
        if full or strict and exhausted is not None:
            failed += 1
            continue
        made += 1
        leak = draw() < cell["leak"]
        leaked += leak
        if not interval:
            calls += now + period <= end
        else:
            calls += int((end - now if leak else min(cell["timer_lifetime"], end - now)) // period)
    delay = latest if strict else min(50.0, calls / (end / 1000) * 0.001)
    return created(cell, made, failed, delay, 2, leaked, leaked, exhausted, calls)


def listeners(cell: dict) -> dict:
    """Listeners: each component adds some to one emitter; emits call all that leaked."""
    draw, n, each = Mulberry(int(cell["seed"])), int(cell["emitters"]), int(cell["per_component"])
    held = [0] * n
    leaked = made = failed = calls = 0
    exhausted, latest = None, 0.0
    strict, end = cell["latency_limit"] >= 0, cell["duration"]
    emits = deque(arrival_times(end, 1000 / cell["emit_hz"])) if cell["emit_hz"] > 0 else deque()
    for now in arrival_times(end, max(1, rounded(1000 / cell["rate"]))):
        while emits and emits[0] <= now:
            emits.popleft()
            calls += leaked
        late = max(held, default=0) * 0.03
        latest = max(latest, late)
        full = leaked * cell["item_bytes"] >= cell["heap_limit"]
        crowded = strict and (late >= cell["latency_limit"] or max(held, default=0) > cell["max_listeners"])
        if exhausted is None and (full or crowded):
            exhausted = now
        if full or strict and exhausted is not None:
            failed += each
            continue
        made += each
        target = int(draw() * n)
        for _ in range(each):
            leak = draw() < cell["leak"]
            leaked += leak
            held[target] += leak
            if exhausted is None and not strict and held[target] > cell["max_listeners"]:
                exhausted = now
    calls += len(emits) * leaked
    latency = latest if strict else (leaked / n if n else 0) * 0.001
    return created(cell, made, failed, latency, 3, leaked, leaked, exhausted, calls)


def simulate(cell: dict) -> dict:
    c = DEFAULTS | {k: v for k, v in cell.items() if v is not None}
    if c["kind"] == "socket":
        keep = c["keep_alive"]
        return queued(c, min(c["hold"] * 0.1, 5.0) if keep else 0.0, 2000.0 if keep else 0.0)
    return {"pool": queued, "fd": rejected, "stream": streams, "timer": timers, "listener": listeners}[c["kind"]](c)


def simulate_grid(cells: DataFrame) -> DataFrame:
    """`cells` has case, y, x and any parameters; every cell is simulated where it lies and gets the result's columns."""
    keep = ["case", "y", "x"]
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            made = pd.DataFrame([{k: r[k] for k in keep} | simulate({k: v for k, v in r.items() if k not in keep and v == v}) for r in rows])
            yield made.astype({c.split()[0]: "float64" for c in RESULT.split(", ")})

    return cells.repartition("case", "y", "x").mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", " + RESULT)
