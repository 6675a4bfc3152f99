"""Semantics that change results: statistics, generators, sampling, simulators, plans."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import prng, stats
from plumbline.functions.rules import percent, round_half_up, to_number, unit_number
from plumbline.functions.tdist import two_sided_p
from plumbline.operators import joins, sampling
from plumbline.operators.simulate import simulate
from plumbline.operators.windows import running_total
from plumbline.sources.tables import require


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_known_p_values():
    got = two_sided_p(np.array([1.0, 2.045, 3.0, 2.0, 0.3, 0.0, np.inf]), np.array([29, 29, 10, 58, 58, 5, 5]))
    assert got[:4] == pytest.approx([0.325582, 0.050024, 0.013344, 0.0502], abs=5e-5)
    assert got[4] == pytest.approx(0.765, abs=1e-3) and got[5] == pytest.approx(1) and np.isnan(got[6])


def stepwise(seed: int, n: int) -> list[float]:
    """The generator's arithmetic step by step, on plain integers."""
    out, a, word = [], seed & 0xFFFFFFFF, 0xFFFFFFFF
    for _ in range(n):
        a = (a + 0x6D2B79F5) & word
        t = ((a ^ (a >> 15)) * (a | 1)) & word
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & word)) & word
        out.append(((t ^ (t >> 14)) & word) / 2**32)
    return out


def test_generators():
    for seed in (0, 42, 2**32 - 1):
        want = stepwise(seed, 10_000)
        assert prng.mulberry32(seed, 10_000).tolist() == want
        draw = prng.Mulberry(seed, block=7)
        assert [draw() for _ in range(10_000)] == want
    order = list(range(9))
    draw = iter(stepwise(42, 8))
    for i in range(8, 0, -1):
        j = math.floor(next(draw) * (i + 1))
        order[i], order[j] = order[j], order[i]
    assert sampling.replayed_draw(list(range(9)), 4, 42) == order[:4]
    assert [prng.spread_hash(s, 1000) for s in (0, 1, 2)] == [0, 761, (2 * 2654435761 % 2**32) % 1000]


def test_rounding_ratios_and_numbers(spark):
    r = one(spark, *[round_half_up(F.lit(x)) for x in (-2.5, 2.5, -0.5)], percent(F.lit(1), F.lit(3)), percent(F.lit(1), F.lit(0)))
    assert tuple(r) == (-2.0, 3.0, 0.0, 33.3, 0.0)
    assert tuple(one(spark, *[to_number(F.lit(s)) for s in ("", "x", "NaN", " 7 ", "1e3")])) == (0.0, 0.0, 0.0, 7.0, 1000.0)
    assert tuple(one(spark, *[unit_number(F.lit(s)) for s in ("∞", "12.5%", "2KB", "1.5 MB", "1,234", "x")])) == (None, 0.125, 2048.0, 1572864.0, 1234.0, None)


def test_three_percentiles_and_two_medians(spark):
    d = spark.createDataFrame([("a", float(x)) for x in (10, 20, 30, 40)] + [("b", 5.0)] + [("n", None)], "k string, x double")
    got = {r["k"]: r for r in stats.percentile_floor(d, ["k"], "x", [(0.5, "m"), (0.95, "p"), (1.0, "top")]).collect()}
    assert (got["a"]["m"], got["a"]["p"], got["a"]["top"], got["b"]["m"]) == (30.0, 40.0, 40.0, 5.0) and "n" not in got
    r = stats.percentiles(d.filter("k = 'a'"), ["k"], "x", [(0.5, "interp", "i"), (0.5, "nearest", "n"), (0.95, "interp", "j"), (0.0, "nearest", "z")]).first()
    assert (r["i"], r["n"], r["z"]) == (25.0, 20.0, 10.0) and r["j"] == pytest.approx(38.5)


def test_effect_sizes_on_degenerate_groups(spark):
    z = F.lit(0.0)
    r = one(
        spark, stats.cohens_d_pooled(F.lit(1.0), F.lit(2.0), z, z, F.lit(5), F.lit(5)), stats.cohens_d_pooled(F.lit(1.0), F.lit(1.0), z, z, F.lit(5), F.lit(5)),
        stats.cohens_d_population(F.lit(1.0), F.lit(2.0), z, z), stats.welch_t(F.lit(1.0), F.lit(1.0), z, z, F.lit(5), F.lit(5))[0], stats.growth_class(F.lit(None).cast("double")), stats.complexity_mean_fit(F.lit(3.456)),
    )
    assert tuple(r) == (None, 0.0, None, 0.0, "Linear or constant", "O(n^3.46)")


def test_published_estimate(spark):
    """Published strata (population, sampled, hits) give the published total and interval."""
    rows = [(6033, 160, 3), (1972, 70, 0), (1281, 70, 2), (633, 70, 17), (139, 30, 2)]
    r = sampling.stratified_total(spark.createDataFrame([(*x, 0) for x in rows], "population long, sampled long, hits long, unsure long")).first()
    assert (round(r["total"], 2), round(r["low"], 2), round(r["high"], 2)) == (312.71, 165.30, 460.13)


def test_stratified_sample_rules(spark):
    p = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(50)] + [(99, "c")], "id int, s string")
    got = sampling.stratified_sample(p, "s", "id", {"a": 10, "b": None, "c": 5}, 20, 1)
    assert {r["s"]: (r["n"], r["w"]) for r in got.groupBy("s").agg(F.count("id").alias("n"), F.first("weight").alias("w")).collect()} == {"a": (10, 2.5), "b": (9, 25 / 9), "c": (1, 1.0)}
    with pytest.raises(ValueError, match="no allocation"):
        sampling.stratified_sample(p, "s", "id", {"a": 1}, 5, 1)


def test_kappa(spark):
    d = spark.createDataFrame([("x", "x")] * 20 + [("x", "y")] * 5 + [("y", "x")] * 10 + [("y", "y")] * 15, "a string, b string")
    r = sampling.cohens_kappa(d, "a", "b").first()
    assert (r["n"], r["agreement"]) == (50, 0.7) and r["kappa"] == pytest.approx(0.4)


def test_joins(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, 5, "late"), (1, 2, "first"), (3, None, "only")], "k int, pos int, v string")
    assert sorted((r["k"], r["v"]) for r in joins.first_match(left, right, "k", "pos").collect())[:2] == [(1, "first"), (2, None)]
    with pytest.raises(ValueError, match="without a match"):
        joins.require_all(left, right.select("k"), "k")
    with pytest.raises(ValueError, match="missing columns: z"):
        require(left, "k", "z")
    a, b = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("aabc", "abbd"))
    assert sorted(map(tuple, joins.multiset_difference(a, b, "k").collect())) == [("a", 1, 0), ("b", 0, 1), ("c", 1, 0), ("d", 0, 1)]
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    kids = spark.createDataFrame([(10, 1), (11, 1), (12, 9)], "cid int, pid int")
    assert {r["id"]: r["kids"] for r in joins.eager_load(parents, kids, "id", "pid", F.col("cid"), "kids").collect()} == {1: [10, 11], 2: []}


def test_running_total_in_ranges(spark):
    d = spark.range(100).select("id", F.lit(1).alias("v"))
    got = running_total(d, "id", "v", "s", range_rows=7).collect()
    assert sorted((r["id"], r["s"]) for r in got) == [(i, i + 1) for i in range(100)]
    assert running_total(d.limit(0), "id", "v", "s").count() == 0


FD = {"kind": "fd", "limit": 1024, "hold": 5.0, "jitter": 1.0, "item_bytes": 1024.0}


@pytest.mark.parametrize(
    ("interval", "leak", "rate"),
    [(50.0, 0.2, 0.0), (5.0, 0.1, 0.0), (5.0, 0.2, 0.14183333333333334), (3.0, 0.2, 0.4851), (1.0, 0.05, 0.31833333333333336), (1.0, 0.1, 0.6513), (1.0, 0.2, 0.8283666666666667)],
)
def test_published_simulator_cells(interval, leak, rate):
    assert simulate(FD | {"interval": interval, "leak": leak})["failure_rate"] == rate


#: Published cells, one row (y) of a grid over its leak probabilities (x).
PUBLISHED = [
    ("stream", "leak-x-workers", "50", "exhausted_at", [None, None, None, 20333, 10338, 5130]),
    ("stream", "leak-x-workers", "10", "leaked", [0, 45, 85, 276, 594, 1024]),
    ("stream", "leak-x-workers", "20", "heap_growth", [0, 6488064, 11337728, 30932992, 64749568, 67108864]),
    ("socket", "leak-x-workers", "1", "failure_rate", [0, 0, 0, 0, 0.14333333333333334, 0.48833333333333334]),
    ("socket", "leak-x-workers", "20", "exhausted_at", [None, 12036, 6441, 2346, 1050, 675]),
    ("socket", "leak-x-workers", "50", "throughput", [990.3333333333334, 207.96666666666667, 117.06666666666666, 38.3, 17.133333333333333, 10.233333333333333]),
    ("timer", "leak-x-rate", "20", "leaked", [0, 8, 12, 32, 65, 117]),
    ("timer", "leak-x-rate", "50", "callbacks", [6755, 6913, 7028, 7511, 8270, 9581]),
    ("listener", "leak-x-listeners", "2", "exhausted_at", [None, None, 13900, 6400, 2000, 1000, 500]),
    ("listener", "leak-x-listeners", "10", "callbacks", [0, 4047, 22527, 46054, 89274, 222703, 448500]),
    ("listener", "leak-x-listeners", "5", "heap_growth", [0, 32768, 299008, 626688, 1204224, 2981888, 6144000]),
]


@pytest.mark.parametrize(("kind", "case", "y", "metric", "row"), PUBLISHED)
def test_published_grid_rows(kind, case, y, metric, row):
    from plumbline.plans.simulations import GRIDS

    cells = [c for c in GRIDS[kind] if c["case"] == case and c["y"] == y]
    assert [simulate(c)[metric] for c in cells] == row


def test_simulator_invariants():
    for kind in ("pool", "socket", "fd", "stream"):
        r = simulate({"kind": kind, "leak": 0.05, "error": 0.1, "leak_on_error": True, "interval": 5.0, "item_bytes": 1000.0})
        assert r["succeeded"] + r["failed"] == r["total"] and r["peak"] <= 20 and r["leaked"] <= 20
    assert simulate({"kind": "pool", "interval": 100.0, "jitter": 0.0})["exhausted_at"] is None
    stopped = simulate({"kind": "timer", "rate": 50.0, "leak": 0.2, "latency_limit": 1.0, "item_bytes": 10.0})
    assert stopped["exhausted_at"] is not None and stopped["failed"] > 0
    assert simulate({"kind": "listener", "rate": 50.0, "leak": 0.5, "per_component": 3})["callbacks"] > 0


def explain(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans_are_the_wanted_ones(spark, sf):
    from plumbline import plans

    plan = lambda name: explain(plans.QUERIES[name](spark, sf))
    assert "EqualTo(o_orderstatus,O)" in plan("flt_03_composite") and "GreaterThanOrEqual(o_orderdate" in plan("flt_03_composite")
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan("prj_01_subset")
    assert "TakeOrderedAndProject" in plan("srt_01_newest")
    assert "LeftSemi" in plan("flt_04_in_computed_set")
    assert "Cartesian" not in plan("join_05_correlated") and "NestedLoop" not in plan("join_17_suffix")
    assert json.dumps(plan("agg_02_grouping_sets")).count("Scan parquet") <= 2


def test_ranged_percentiles_match_sorted_values(spark):
    """Null and hot keys, repeated values, few and many values; any number of ranges."""
    import math
    import random

    r = random.Random(3)
    data = {None: [r.choice([1.0, 2.0, 5.0]) for _ in range(900)], "a": [r.random() for _ in range(500)], "b": [7.0], "c": [1.0, None, 3.0], "d": [None]}
    rows = [(k, v) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = [(0.5, "interp", "mid"), (0.95, "floor", "p95f"), (0.95, "nearest", "p95n")]

    def plain(values):
        s = sorted(v for v in values if v is not None)
        n, pos = len(s), (len(s) - 1) * 0.5
        low, high = s[math.floor(pos)], s[math.ceil(pos)]
        return (low + (high - low) * (pos - math.floor(pos)), s[min(math.floor(n * 0.95), n - 1)], s[max(math.ceil(n * 0.95) - 1, 0)])

    want = {k: plain(vs) for k, vs in data.items() if k != "d"}
    for ranges in (2, 7, 64):
        got = {x["k"]: (x["mid"], x["p95f"], x["p95n"]) for x in stats.percentiles(df, ["k"], "v", wanted, ranges).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert stats.percentiles(df, [], "v", wanted).first()["mid"] == pytest.approx(plain([v for vs in data.values() for v in vs])[0])
    totals = df.groupBy("k").count()
    assert {x["k"]: x["mid"] for x in stats.with_percentiles(totals, df, ["k"], "v", wanted).collect()} == {**{k: pytest.approx(v[0]) for k, v in want.items()}, "d": None}


def test_group_facts_keep_null_and_hot_keys(spark):
    from plumbline.operators.joins import join_facts

    rows = [(None, 1), (None, 2)] + [("hot", i) for i in range(3, 5000)] + [(str(i), i) for i in range(5000, 5100)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {(x["k"], x["v"]): x["least"] for x in join_facts(df, ["k"], "least", F.min("v")).collect()}
    assert got == {(k, v): 1 if k is None else 3 if k == "hot" else v for k, v in rows}


def test_running_total_of_clustered_keys(spark):
    from plumbline.operators.windows import running_total

    keys = list(range(2000)) + [10**12 + 7 * i for i in range(500)]
    df = spark.createDataFrame([(k, k % 5) for k in keys], "k long, v int")
    total, want = 0, {}
    for k in sorted(keys):
        total += k % 5
        want[k] = total
    assert {r["k"]: r["s"] for r in running_total(df, "k", "v", "s", range_rows=100).collect()} == want


def test_latency_summary_of_any_order_and_nulls(spark, tmp_path):
    """The mean is that of the exact sum, whatever the order of rows; null values take positions, null is a type."""
    import duckdb

    from plumbline import plans

    values = [1e12, *[round(math.sqrt(i + 0.5), 6) for i in range(4000)], -1e12]
    rows = [("a", v) for v in values] + [("b", v) for v in (3.5, None, 1.25, None, None)] + [("c", None), (None, 2.5), (None, None)]
    spark.createDataFrame(list(reversed(rows)), "event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_type"]: r for r in plans.QUERIES["agg_26_latency_summary"](spark, str(tmp_path)).collect()}
    assert got["a"]["mean"] == round(math.fsum(values) / len(values), 9)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0]: r for r in db.sql(f"SELECT event_type, lo, hi, p50_floor, p95_floor, p99_floor FROM ({plans.ORACLE['agg_26_latency_summary']})").fetchall()}
    assert {k: (k, r["lo"], r["hi"], r["p50_floor"], r["p95_floor"], r["p99_floor"]) for k, r in got.items()} == want
    assert {k: got[k]["mean"] for k in ("b", "c", None)} == {"b": 2.375, "c": None, None: 2.5}
    far = spark.createDataFrame([("x", 1e25), ("x", 3e25), ("y", float("inf"))], "k string, v double").groupBy("k").agg(stats.exact_mean(F.col("v")).alias("m"))
    assert {r["k"]: r["m"] for r in far.collect()} == {"x": 2e25, "y": math.inf}


def test_padded_ids_of_many_suppliers(spark, tmp_path):
    """Over 999 rows and a null key give what the SQL gives, also when the total is made in ranges."""
    import duckdb

    from plumbline import plans

    spark.createDataFrame([(None if k == 0 else k * 3,) for k in range(1205)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = [tuple(r) for r in plans.QUERIES["win_09_padded_ids"](spark, str(tmp_path)).select("s_suppkey", "id").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, db.sql(plans.ORACLE["win_09_padded_ids"]).fetchall()))
    d = spark.createDataFrame([(None, 1), (5, 1), (7, 1), (-2, 1)], "k long, v int")
    assert {r["k"]: r["s"] for r in running_total(d, "k", "v", "s", range_rows=2).collect()} == {-2: 1, 5: 2, 7: 3, None: 4}


def test_bootstrap_in_chunks_and_blocks(spark):
    """Slopes of resamples that are drawn in parts equal those of loops; nulls, equal x, negative modules."""
    r = np.random.default_rng(5)
    points = [(m, k * 2, float(r.integers(1, 9)), None if k % 7 == 3 and m == 1 else float(r.normal())) for m, c in ((-3, 23), (1, 17), (2, 1)) for k in range(c)] + [(4, k, 2.5, float(k)) for k in range(6)] + [(None, 1, 1.0, 1.0)]
    cut = lambda v: int(math.fmod(v, 2147483647))
    want = {}
    for m in (-3, 1, 2, 4):
        xy = [(x, y) for k, _, x, y in points if k == m]
        for i in range(11):
            drawn = []
            for j in range(len(xy)):
                h = cut(j * 16807 + i * 48271 + m * 69621 + 12345) ** 2 % 2147483647
                drawn.append(xy[(((h * 48271 + i) % 2147483647) ** 2 % 2147483647 * 69621 + j) % 2147483647 % len(xy)])
            drawn = [(x, y) for x, y in drawn if y is not None]
            want[m, i] = np.polyfit(*zip(*drawn, strict=True), 1)[0] if len({x for x, _ in drawn}) > 1 else None
    df = spark.createDataFrame(points, "module int, k long, x double, y double").repartition(3)
    for chunk, draws, blocks in ((1 << 22, 1 << 27, 32), (5, 40, 32), (23, 1, 4)):
        got = {(g["module"], g["i"]): g["b"] for g in sampling.bootstrap_slopes(df, "k", 11, chunk, draws, blocks).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] is None if b is None else got[k] == pytest.approx(b, abs=1e-9) for k, b in want.items())


def test_bootstrap_of_few_points_matches_sql(spark, tmp_path):
    """A module of one customer has no slope (null here, NaN in DuckDB) and keeps its row, as in the SQL; a null customer has no module."""
    import duckdb

    from plumbline import plans

    rows = [(11, 5.0), (1, 2.0), (1, 3.0), (12, 4.0), (23, 9.5), (23, 1.5), (23, 2.5), (2, 7.0), (13, 8.0), (None, 1.0)]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = [tuple(r) for r in plans.QUERIES["st_14_bootstrap"](spark, str(tmp_path)).select("module", "lo", "hi").collect()]
    want = [tuple(None if v != v else v for v in r) for r in db.sql(plans.ORACLE["st_14_bootstrap"]).fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 3
