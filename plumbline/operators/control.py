"""Measuring queries: modules in variants, trials, jobs, layouts, and matches that are ended after a time."""

from __future__ import annotations

import json
import select
import subprocess
import sys
import time
import uuid
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


class Module(Protocol):
    """Two ways to one result."""

    name: str

    def baseline(self) -> DataFrame: ...

    def optimized(self) -> DataFrame: ...


def verified(module: Module) -> bool:
    """Both variants give the same rows, repeats counted."""
    a, b = module.baseline(), module.optimized()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def trials(work: Callable[[], object], n: int = 3, warmup: int = 1, pause: float = 0.0) -> list[float]:
    """Milliseconds of n runs after `warmup` unmeasured ones, `pause` seconds apart."""
    out = []
    for k in range(warmup + n):
        began = time.perf_counter()
        work()
        if k >= warmup:
            out.append((time.perf_counter() - began) * 1000)
        time.sleep(pause)
    return out


def run_module(spark: SparkSession, module: Module, n: int = 3) -> DataFrame:
    """Rows (module, variant, trial, ms, verified) of all trials of both variants."""
    good = verified(module)
    rows = [
        (module.name, variant, k, ms, good)
        for variant, make in (("baseline", module.baseline), ("optimized", module.optimized))
        for k, ms in enumerate(trials(lambda make=make: make().write.format("noop").mode("overwrite").save(), n))
    ]
    return spark.createDataFrame(rows, "module string, variant string, trial int, ms double, verified boolean")


def jobs_of(spark: SparkSession, work: Callable[[], object]) -> int:
    """How many Spark jobs `work` runs."""
    context, group = spark.sparkContext, f"count-{uuid.uuid4().hex}"
    context.setJobGroup(group, "counted")
    try:
        work()
        return len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def exchanges(df: DataFrame) -> int:
    """Shuffles in the physical plan."""
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")


def retention(spark: SparkSession, make: Callable[[int], DataFrame], cycles: int, clean: bool) -> list[int]:
    """Cached tables beyond those of before, after each cycle of mounting one (cached and read) and, if clean, unmounting it.

    What a leaking cycle leaves is released at the end.
    """
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, mounted, out = held(), [], []
    try:
        for k in range(cycles):
            mounted.append(make(k).persist())
            mounted[-1].count()
            if clean:
                mounted.pop().unpersist(blocking=True)
            out.append(held() - before)
        return out
    finally:
        for frame in mounted:
            frame.unpersist(blocking=True)


#: What the helper process runs: a JSON line [pattern, input] in, a JSON line (matched, or null for an unreadable pattern) out.
HELPER = """
import json, re, sys
for line in sys.stdin:
    pattern, text = json.loads(line)
    try:
        out = re.search(pattern, text) is not None
    except re.error:
        out = None
    print(json.dumps(out), flush=True)
"""


class Matcher:
    """Runs matches in a process of its own, which is killed when one takes too long."""

    def __init__(self, seconds: float):
        self.seconds, self.process = seconds, None

    def match(self, pattern: str, text: str) -> tuple[bool | None, bool]:
        """(matched, timed out)."""
        if self.process is None:
            self.process = subprocess.Popen([sys.executable, "-c", HELPER], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)
            self.process.stdin.write(json.dumps(["", ""]) + "\n")
            self.process.stdin.flush()
            self.process.stdout.readline()  # started; what follows is the match's own time
        self.process.stdin.write(json.dumps([pattern, text]) + "\n")
        self.process.stdin.flush()
        if select.select([self.process.stdout], [], [], self.seconds)[0]:
            return json.loads(self.process.stdout.readline()), False
        self.close()
        return None, True

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            self.process = None


def timed_matches(pairs: DataFrame, pattern: str, text: str, seconds: float = 1.0) -> DataFrame:
    """Every distinct (pattern, text) once: matched (null if unreadable or ended) and timed_out. Null cells do not run."""

    def run(batches):
        matcher = Matcher(seconds)
        try:
            for batch in batches:
                p, t = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = [(None, False) if a is None or b is None else matcher.match(a, b) for a, b in zip(p, t, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([m for m, _ in out], pa.bool_()), pa.array([e for _, e in out], pa.bool_())], names=[pattern, text, "matched", "timed_out"]
                )
        finally:
            matcher.close()

    return pairs.select(pattern, text).distinct().mapInArrow(run, f"`{pattern}` string, `{text}` string, matched boolean, timed_out boolean")
