"""Measurement of queries, and detectors that are registered, verified and ended after a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import control
from ..operators import detect as D
from ..sources.tables import Tables
from .registry import query

C = F.col


class Lookups:
    """Customers of some orders: one query an order, or one join."""

    name = "lookups"

    def __init__(self, t: Tables):
        self.t, self.keys = t, [1, 2, 3]

    def baseline(self) -> DataFrame:
        out = None
        for k in self.keys:
            one = self.t.customer.filter(C("c_custkey") == k).select("c_custkey", "c_name")
            out = one if out is None else out.unionByName(one)
        return out

    def optimized(self) -> DataFrame:
        return self.t.customer.filter(C("c_custkey").isin(self.keys)).select("c_custkey", "c_name")


@query("SELECT 'lookups' AS module, variant, (SELECT count(*) FROM customer WHERE c_custkey IN (1, 2, 3)) <= 3 AS verified, 2::BIGINT AS trials FROM (SELECT unnest(['baseline', 'optimized']) AS variant)")
def udf_01_modules(t: Tables) -> DataFrame:
    """A module's variants, verified against each other and run in trials."""
    runs = control.run_module(t.spark, Lookups(t), n=2)
    return runs.groupBy("module", "variant").agg(F.every("verified").alias("verified"), F.count(F.lit(1)).alias("trials"))


@query()
def ctl_01_layout(t: Tables) -> DataFrame:
    """What an index is to a database a bucketed layout is here: shuffles of a grouping without and with it."""
    name = f"layout_{uuid.uuid4().hex}"
    plain = t.orders.select("o_custkey", "o_orderkey")
    plain.write.bucketBy(8, "o_custkey").sortBy("o_custkey").saveAsTable(name)
    try:
        count = lambda d: control.exchanges(d.groupBy("o_custkey").agg(F.count(F.lit(1))))
        rows = [("plain", count(plain)), ("bucketed", count(t.spark.table(name)))]
    finally:
        t.spark.sql(f"DROP TABLE {name}")
    return t.spark.createDataFrame(rows, "layout string, shuffles int")


@query()
def ctl_03_jobs(t: Tables) -> DataFrame:
    """Jobs of one query a key, and of one query for all keys."""
    m = Lookups(t)
    one_by_one = lambda: [t.customer.filter(C("c_custkey") == k).collect() for k in m.keys]
    rows = [("one by one", control.jobs_of(t.spark, one_by_one)), ("batched", control.jobs_of(t.spark, m.optimized().collect))]
    return t.spark.createDataFrame(rows, "style string, jobs int")


@query()
def ctl_04_trials(t: Tables) -> DataFrame:
    """Milliseconds of trials after a warm-up."""
    runs = control.trials(lambda: t.orders.groupBy("o_orderstatus").count().collect(), n=3, warmup=1)
    return t.spark.createDataFrame(list(enumerate(runs)), "trial int, ms double")


@query("SELECT p_partkey, [false, true, false][p_partkey % 3 + 1] AS timed_out, [true, NULL, false][p_partkey % 3 + 1] AS matched FROM part")
def ctl_05_timeouts(t: Tables) -> DataFrame:
    """Matches run in a process that is ended after a time; each distinct one runs once."""
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (C("p_partkey") % 3).cast("int"))
    rows = t.part.select("p_partkey", pick("^a+$", "^(a+)+$", "^a+$").alias("pattern"), pick("aaaa", "a" * 40 + "!", "ab").alias("input"))
    return rows.join(control.timed_matches(rows, "pattern", "input", 1.0), ["pattern", "input"]).select("p_partkey", "timed_out", "matched")


@query("SELECT scenario, cycle::INT AS cycle, CASE scenario WHEN 'leaking' THEN cycle + 1 ELSE 0 END::INT AS retained FROM (SELECT unnest(['leaking', 'clean']) AS scenario), range(5) r(cycle)")
def ctl_06_retention(t: Tables) -> DataFrame:
    """What mount and unmount cycles leave behind: cached tables of a job that releases them, and of one that does not."""
    make = lambda k: t.customer.filter(C("c_nationkey") == k).select("c_custkey")
    rows = [(name, k, n) for name, clean in (("leaking", False), ("clean", True)) for k, n in enumerate(control.retention(t.spark, make, 5, clean))]
    return t.spark.createDataFrame(rows, "scenario string, cycle int, retained int")


@query("SELECT p_partkey, ['gone', 'still', 'misplaced', 'gone'][p_partkey % 4 + 1] AS verdict FROM part")
def det_19_fix_verification(t: Tables) -> DataFrame:
    """A suggestion is good if the finding it is for is gone after it."""
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (C("p_partkey") % 4).cast("int"))
    call = "a = fs.readFileSync(p);\nb = fs.statSync(p);"
    fixes = t.part.select(
        "p_partkey", F.lit(call).alias("text"), pick(4, 4, 0, 28).alias("start"), pick("fs.readFileSync(p)", "fs.readFileSync(p)", "fs.readFileSync(p)", "fs.statSync(p)").alias("before"),
        pick("await fs.promises.readFile(p)", "fs.openSync(p)", "x", "await fs.promises.stat(p)").alias("after"),
    )
    return D.verified_fixes(fixes, "p_partkey", "blocking_file", D.blocking_calls)


@query(
    """SELECT p_partkey, 2::INT AS line, rule FROM (SELECT p_partkey, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['nested-loops'] ELSE ['regex-in-loop'] END) AS rule FROM part WHERE p_partkey % 3 <> 0)"""
)
def udf_03_rule_registry(t: Tables) -> DataFrame:
    """Detectors by name, as a table function of SQL."""
    D.register_rules(t.spark, "findings")
    text = F.when(C("p_partkey") % 3 == 0, F.lit(None)).when(C("p_partkey") % 2 == 0, "for a in b:\n  for c in d: pass\n").otherwise("for a in b:\n  re.match(a, b)\n")
    t.part.select("p_partkey", text.alias("text")).createOrReplaceTempView("registry_sources")
    return t.spark.sql("SELECT p_partkey, f.line, f.rule FROM registry_sources, LATERAL findings('python_loops', text) f")
