"""Simulated grids, 27 and two capped variants: literal axes crossed, one cell simulated at a time, read back as long tables and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.simulate import simulate_grid
from ..sources.tables import Tables
from .registry import query

#: The axes of the grids.
LEAKS = [0.0, 0.01, 0.02, 0.05, 0.1, 0.2]
ERRORS = [0.0, 0.01, 0.05, 0.1, 0.15, 0.2, 0.3]
WORKERS = [1, 5, 10, 20, 50, 100]
HANDLING = [(leak_on_error, leak) for leak_on_error in (False, True) for leak in (0.0, 0.02, 0.05, 0.1)]
FD_LIMITS = [64, 128, 256, 512, 1024, 4096]
CLOSURES = [0, 1024, 4096, 16384, 65536, 262144, 1048576]


def grid(case: str, ys: list, xs: list, cell, **base) -> list[dict]:
    """y-major cells; `cell(y, x)` gives the parameters of one."""
    return [{"case": case, "y": str(y), "x": str(x)} | base | cell(y, x) for y in ys for x in xs]


def interval(workers: int) -> float:
    """Workers enter as arrivals: one every 50 ms / workers."""
    return float(max(1, int(50 / workers + 0.5)))


def on_error(y, x) -> dict:
    return {"leak_on_error": y[0], "leak": y[1], "error": x}


POOL = {"kind": "pool", "interval": 5.0}
FD = {"kind": "fd", "limit": 1024, "hold": 5.0, "jitter": 1.0, "item_bytes": 1024.0, "interval": 5.0}
STREAM = {"kind": "stream", "limit": 1024, "hold": 10.0, "jitter": 2.0, "item_bytes": 65536.0, "interval": 5.0}
SOCKET = {"kind": "socket", "limit": 50, "hold": 50.0, "jitter": 10.0, "timeout": 5000.0, "interval": 5.0}
TIMER = {"kind": "timer", "item_bytes": 4096.0, "rate": 20.0}
LISTENER = {"kind": "listener", "item_bytes": 4096.0, "rate": 10.0}


def by_workers(y, x) -> dict:
    return {"interval": interval(y), "leak": x}


def transfer(y, x) -> dict:
    """A response holds its socket for 10 ms and its bytes at 100 MB/s."""
    return {"interval": interval(y), "hold": 10 + max(1.0, x / (100 * 1024 * 1024 / 1000)), "jitter": 2.0, "leak": 0.05, "timeout": 30_000.0}


GRIDS: dict[str, list[dict]] = {
    "pool": grid("leak-x-workers", WORKERS, LEAKS, by_workers, kind="pool")
    + grid("hold-x-limit", [5, 10, 20, 50, 100], [5, 20, 50, 100, 200, 500, 1000], lambda y, x: {"limit": y, "hold": float(x), "jitter": x * 0.2, "leak": 0.05}, **POOL)
    + grid("burst-x-timeout", [50, 100, 500, 1000, 2000, 5000], [1, 5, 10, 20, 30, 50], lambda y, x: {"timeout": float(y), "burst": x, "burst_interval": 200.0, "leak": 0.05}, kind="pool")
    + grid("error-x-handling", HANDLING, ERRORS, on_error, **POOL)
    + grid("leak-x-limit", [5, 10, 20, 50, 100, 200], LEAKS, lambda y, x: {"limit": y, "leak": x}, **POOL),
    "fd": grid("leak-x-workers", WORKERS, LEAKS, by_workers, **FD)
    + grid("size-x-limit", FD_LIMITS, [1024, 10240, 102400, 1048576, 10485760, 104857600], lambda y, x: {"limit": y, "item_bytes": float(x), "leak": 0.05}, **FD)
    + grid("error-x-handling", HANDLING, ERRORS, on_error, **FD)
    + grid("rate-x-limit", FD_LIMITS, [10, 50, 100, 200, 500, 1000], lambda y, x: {"limit": y, "interval": float(max(1, int(1000 / x + 0.5))), "leak": 0.05}, **FD),
    "stream": grid("leak-x-workers", WORKERS, LEAKS, by_workers, **STREAM)
    + grid("size-x-leak", LEAKS, [1024, 10240, 65536, 524288, 5242880, 52428800], lambda y, x: {"leak": y, "item_bytes": float(x)}, **STREAM)
    + grid("error-x-handling", HANDLING, ERRORS, on_error, **STREAM)
    + grid("type-x-leak", ["read", "write", "transform"], LEAKS, lambda y, x: {"stream_type": y, "leak": x, "hold": 20.0, "jitter": 5.0, "item_bytes": 1048576.0}, **STREAM),
    "socket": grid("leak-x-workers", WORKERS, LEAKS, by_workers, **SOCKET)
    + grid("timeout-x-workers", WORKERS, [50, 100, 500, 1000, 2000, 5000, 10000], lambda y, x: {"interval": interval(y), "timeout": float(x), "leak": 0.05}, **SOCKET)
    + grid("error-x-handling", HANDLING, ERRORS, on_error, **SOCKET)
    + grid("size-x-workers", WORKERS, [1024, 10240, 102400, 1048576, 5242880, 10485760], transfer, **SOCKET)
    + grid("keepalive-x-leak", [False, True], [0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2], lambda y, x: {"keep_alive": y, "leak": x}, **SOCKET),
    "timer": grid("leak-x-rate", WORKERS, LEAKS, lambda y, x: {"rate": float(y), "leak": x}, **TIMER)
    + grid("closure-x-leak", LEAKS, CLOSURES, lambda y, x: {"leak": y, "item_bytes": float(x)}, **TIMER)
    + grid("interval-x-rate", WORKERS, [1, 10, 50, 100, 500, 1000, 5000], lambda y, x: {"rate": float(y), "timer_interval": float(x), "leak": 1.0, "item_bytes": 1024.0}, **TIMER)
    + grid("type-x-leak", ["timeout", "interval"], [*LEAKS, 0.5, 1.0], lambda y, x: {"timer_type": y, "leak": x}, **TIMER)
    + grid("capped", WORKERS, LEAKS, lambda y, x: {"rate": float(y), "leak": x, "latency_limit": 5.0, "heap_limit": 1048576.0}, **TIMER),
    "listener": grid("leak-x-listeners", [1, 2, 5, 10, 20, 50, 100], [0.0, 0.01, 0.05, 0.1, 0.2, 0.5, 1.0], lambda y, x: {"per_component": y, "leak": x}, **LISTENER)
    + grid("closure-x-leak", LEAKS, CLOSURES, lambda y, x: {"leak": y, "item_bytes": float(x), "max_listeners": 100}, **LISTENER)
    + grid("frequency-x-listeners", [1, 10, 50, 100, 500, 1000], [1, 10, 50, 100, 500, 1000], lambda y, x: {"per_component": y, "emit_hz": float(x), "leak": 1.0, "item_bytes": 1024.0, "rate": 1.0, "max_listeners": 10000}, **LISTENER)
    + grid("emitters-x-listeners", [1, 5, 10, 20, 50, 100], [1, 2, 5, 10, 20, 50, 100], lambda y, x: {"per_component": y, "emitters": x, "leak": 0.05}, **LISTENER)
    + grid("type-x-leak", ["on", "once"], [*LEAKS, 0.5, 1.0], lambda y, x: {"listener_type": y, "leak": x}, **LISTENER)
    + grid("capped", [1, 2, 5, 10], LEAKS, lambda y, x: {"per_component": y, "leak": x, "latency_limit": 5.0}, **LISTENER),
}


def cells(t: Tables, kind: str) -> DataFrame:
    rows = GRIDS[kind]
    names = list(dict.fromkeys(k for r in rows for k in r))
    kind_of = {bool: "boolean", int: "int", float: "double", str: "string"}
    schema = ", ".join(f"`{n}` {next(kind_of[type(r[n])] for r in rows if n in r)}" for n in names)
    return t.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@query()
def sim_01_pool(t: Tables) -> DataFrame:
    return simulate_grid(cells(t, "pool"))


@query()
def sim_02_descriptors(t: Tables) -> DataFrame:
    return simulate_grid(cells(t, "fd"))


@query()
def sim_03_streams(t: Tables) -> DataFrame:
    return simulate_grid(cells(t, "stream"))


@query()
def sim_04_sockets(t: Tables) -> DataFrame:
    return simulate_grid(cells(t, "socket"))


@query()
def sim_05_timers(t: Tables) -> DataFrame:
    return simulate_grid(cells(t, "timer"))


@query()
def sim_06_listeners(t: Tables) -> DataFrame:
    return simulate_grid(cells(t, "listener"))


@query()
def sim_07_grid_pivot(t: Tables) -> DataFrame:
    """One metric of a grid as a y by x table; null is never."""
    g = simulate_grid(cells(t, "pool").filter("case = 'leak-x-workers'"))
    return g.groupBy("y").pivot("x", [str(x) for x in LEAKS]).agg(F.first("exhausted_at"))


STEPS = "SELECT event_id, user_id, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END AS held FROM events"


@query(f"SELECT user_id, min(event_id) FILTER (WHERE active > 10) AS first_error, count(*) FILTER (WHERE active <= 10)::BIGINT AS served FROM (SELECT *, sum(held) OVER (PARTITION BY user_id ORDER BY event_id) AS active FROM ({STEPS})) GROUP BY 1")
def sim_08_acquire_release(t: Tables) -> DataFrame:
    """A counter of resources held per iteration against a limit of ten; the first excess is the first error."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    held = F.when(F.col("event_type") == "signup", 0).otherwise(1)
    e = t.events.select("user_id", "event_id", F.sum(held).over(w).alias("active"))
    return e.groupBy("user_id").agg(F.min(F.when(F.col("active") > 10, F.col("event_id"))).alias("first_error"), F.count_if(F.col("active") <= 10).alias("served"))


@query("SELECT event_id, event_id * 1000.0::DOUBLE / 200 AS due, event_id * 1000.0::DOUBLE / 200 + value - event_id * 1000.0::DOUBLE / 200 AS latency FROM events")
def sim_09_open_loop(t: Tables) -> DataFrame:
    """Latency counts from when a request was due, not from when it was sent."""
    due = F.col("event_id") * 1000.0 / 200
    return t.events.select("event_id", due.alias("due"), (due + F.col("value") - due).alias("latency"))
