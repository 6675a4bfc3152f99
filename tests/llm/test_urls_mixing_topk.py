from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.mixing import mix
from plumbline.llm.topk import LONG, beyond, block_topk, clamped, integer_vectors, top_k
from plumbline.llm.url_filter import filter_urls

RULES = "host string, path string, verdict string"


def test_url_parts_and_precedence(spark):
    rules = spark.createDataFrame(
        [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("a.b", "", "block"), (None, "/x", "block"), ("", "/", "block"), ("com", "/en/", "block")], RULES
    )
    urls = [
        ("http://WWW.Example.COM/en/77?q=/en/", "www.example.com", "/en/77", "example.com/en/7", "allow"),
        ("https://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("http://com/en/", "com", "/en/", "com/en/", "block"),
        ("http://com/en", "com", "/en", None, "allow"),
        ("http://xcom/en/", "xcom", "/en/", None, "allow"),
        ("ftp://x.a.b#top", "x.a.b", "", "a.b", "block"),
        ("http://x.a.b?y=1", "x.a.b", "", "a.b", "block"),
        ("a://b.com/en/://c", "b.com", "/en/://c", "com/en/", "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://", "", "", None, "allow"),
        ("http://ÄB.com/en/" + "x" * 50_000, "Äb.com", "/en/" + "x" * 50_000, "com/en/", "block"),
        ("http://" + "a." * 300 + "com/en/", "a." * 300 + "com", "/en/", "com/en/", "block"),
    ]
    pages = spark.createDataFrame([(i, u[0], "clash", "clash") for i, u in enumerate(urls + urls[:2])], "page_id int, url string, host string, rule string")
    for limit in (10, 0):  # broadcast, then shuffled rules
        got = {r["page_id"]: r for r in filter_urls(pages, rules, broadcast_rules=limit).collect()}
        assert len(got) == len(urls) + 2
        for i, u in enumerate(urls + urls[:2]):
            r = got[i]
            assert (r["url"], r["host"], r["path"], r["rule"], r["verdict"]) == u
    empty = filter_urls(pages, spark.createDataFrame([], RULES)).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in empty] == [(None, "allow")]
    assert filter_urls(pages.limit(0), rules).count() == 0


def test_a_url_of_half_of_all_rows_is_no_task(spark):
    """Its rows stay where they are: they meet their decision by broadcast, whatever the size of the tables."""
    rules = spark.createDataFrame([("com", "/en/", "block")], RULES)
    pages = spark.range(60_000).selectExpr("id AS page_id", "if(id % 2 = 0, 'http://a.com/en/x', if(id % 7 = 0, null, concat('http://b', id % 20000, '.com/en'))) AS url").repartition(8)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = filter_urls(pages, rules, broadcast_rules=0)
        sizes = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert max(r["count"] for r in sizes) < 12_000
        assert {tuple(r) for r in got.groupBy("verdict").count().collect()} == {("block", 30_000), ("allow", 30_000)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def water(sizes, weights, share=1.5, cap=2.0):
    """Share by weight; what stands above its cap is shared again among the others, until none is above."""
    left, open_ = share * sum(sizes.values()), set(sizes)
    target = {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def check_mix(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    for s in sizes:  # epochs first, then key order: at most one document is on the border
        part = sorted((r for r in rows if r["source"] == s and r["size"]), key=lambda r: (r["es_key"], r["id"] is not None, r["id"]))
        extra = [r["taken"] - r["epochs"] * r["size"] for r in part]
        assert sum(0 < e < r["size"] for e, r in zip(extra, part, strict=True)) <= 1
        assert extra == sorted(extra, key=lambda e: e == 0) or all(e == 0 or e == r["size"] for e, r in zip(extra, part, strict=True)) or sum(extra) > 0


def test_mixing(spark, odd_docs, no_docs, sf):
    rows = mix(odd_docs).collect()
    assert len(rows) == 11
    check_mix(rows)
    assert next(r for r in rows if r["id"] == 4)["size"] == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, again = (sorted(map(tuple, mix(docs.repartition(n)).collect())) for n in (1, 5))
    assert first == again
    check_mix(mix(docs).collect())
    assert mix(no_docs).count() == 0
    assert {r["target"] for r in mix(odd_docs.where("text is null or text = ''")).collect()} == {0.0}


def test_mixing_ranges_do_not_change_sums(spark, sf, monkeypatch):
    import plumbline.llm.mixing as m

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.lit("one"))
    whole = sorted((r["id"], r["taken"]) for r in m.mix(docs).collect())
    monkeypatch.setattr(m, "BUCKET_ROWS", 3)
    assert sorted((r["id"], r["taken"]) for r in m.mix(docs).collect()) == whole


def test_mixing_of_many_copies(spark, monkeypatch):
    """Null ids and repeated rows share one key: most rows of a source are one range, cut into parts and dealt out again."""
    import plumbline.llm.mixing as m

    monkeypatch.setattr(m, "BUCKET_ROWS", 7)
    monkeypatch.setattr(m, "ROWS_PER_TASK", 50)
    rows = [(None, "a", "one two three")] * 300 + [(i % 9, "a", "x " * (i % 5)) for i in range(90)] + [(1, "b", None)] * 40 + [(2, "b", "y y")] * 200
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    plan = m.mix(docs).collect()
    assert len(plan) == len(rows)
    check_mix(plan)
    full = [r for r in plan if r["id"] is None and r["taken"] - r["epochs"] * 3 == 3]
    assert len([r for r in plan if r["id"] is None]) == 300 and len(full) > 7
    again = m.mix(docs.repartition(11)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, plan))


def test_rules_of_one_host_do_not_expand_others(spark):
    """Hosts with rules of many path lengths, subdomains with rules of their own, and a rule for a host that no url has."""
    r = random.Random(4)
    hosts = ["a.com", "b.a.com", "c.org", "d.c.org", "unseen.net"]
    rules = list({(h, "/" + "".join(r.choice("xy/") for _ in range(r.randrange(6))), r.choice(["allow", "block"])) for h in hosts for _ in range(8)})
    urls = ["http://" + r.choice(["", "w.", "b.", "d."]) + r.choice(["a.com", "c.org", "e.com"]) + "/" + "".join(r.choice("xy/") for _ in range(r.randrange(8))) for _ in range(300)]

    def plain(host, path):
        fits = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[3:] if fits else (None, "allow")

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    for limit in (1000, 0):
        got = filter_urls(pages, spark.createDataFrame(rules, RULES), broadcast_rules=limit).collect()
        assert len(got) == len(urls)
        assert all((g["rule"], g["verdict"]) == plain(g["host"], g["path"]) for g in got)


def brute_topk(qids, q, ids, x, k):
    out = []
    for i, row in zip(qids, q, strict=True):
        s = sorted((-sum(int(a) * int(b) for a, b in zip(row, v, strict=True)), j) for j, v in zip(ids, x, strict=True) if j != i)
        out += [(i, n + 1, j, -score) for n, (score, j) in enumerate(s[:k])]
    return sorted(out)


def test_block_topk_matches_brute_force_and_prunes():
    r = np.random.default_rng(1)
    for trial in range(20):
        n, d = int(r.integers(1, 90)), int(r.integers(1, 6))
        x = r.integers(-3, 4, (n, d))
        ids = r.permutation(200)[:n]
        q, qids = x[: max(1, n // 3)], ids[: max(1, n // 3)]
        rows, got, scores, _ = block_topk(qids, q, ids, x, 5, block=7)
        found = defaultdict(list)
        for i, j, s in zip(rows, got, scores, strict=True):
            found[i].append((-s, j))
        mine = sorted((qids[i], n + 1, j, -s) for i, v in found.items() for n, (s, j) in enumerate(sorted(v)))
        assert mine == brute_topk(qids, q, ids, x, 5)
    near = np.repeat(np.eye(8, dtype=np.int64) * 100, 64, axis=0)
    *_, (scored, pruned) = block_topk(np.arange(4), near[:4], np.arange(len(near)), near, 5, block=64)
    assert scored == 4 and pruned == 28
    big = np.full((6, 3), 2**40)
    assert block_topk(np.arange(2), big[:2], np.arange(6), big, 5)[2][0] == 3 * 2**80


def test_wide_vectors_are_exact_and_pruned():
    """Mixed magnitudes up to the limits of a double, near ties that rounding would hide, and repeated vectors."""
    r = np.random.default_rng(3)
    for trial in range(25):
        n, d = int(r.integers(2, 80)), int(r.integers(1, 6))
        x = np.floor(r.normal(size=(n, d)) * 10.0 ** r.choice([0, 3, 12, 20, 40, 150, 300], (n, 1 if trial % 2 else d)))
        if trial % 3 == 0:
            x = np.full((n, d), 2.0**60) + np.ldexp(r.integers(0, 3, (n, d)).astype(float), 8)
        x[n // 2 :: 3] = x[0]
        ids = r.permutation(200)[:n]
        q, qids = x[: max(1, n // 3)], ids[: max(1, n // 3)]
        rows, got, scores, _ = block_topk(qids, q, ids, x, 5, block=7)
        found = defaultdict(list)
        for i, j, s in zip(rows, got, scores, strict=True):
            found[i].append((-int(s), j))
        mine = sorted((qids[i], n + 1, j, -s) for i, v in found.items() for n, (s, j) in enumerate(sorted(v)))
        assert mine == brute_topk(qids, q, ids, x, 5)
    near = np.repeat(np.eye(8) * 1e38, 64, axis=0)
    *_, (scored, pruned) = block_topk(np.arange(4), near[:4], np.arange(len(near)), near, 5, block=64)
    assert scored == 4 and pruned == 28
    order = [-(10**90), -(10**30) - 1, -(10**30), -LONG, 0, LONG - 1, LONG, 10**30, 10**30 + 1, 10**90]
    assert sorted(order, key=lambda s: (clamped(s), beyond(s))) == order


def test_top_k_of_large_finite_components(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([1e38, -1e38, 3e37, 0.5, -2.25, 0.0]) * r.choice([1, 0.5]) for _ in range(3)]) for i in range(150)] + [(151, [1e308, 0.0, 0.0])]
    rows += [(7, [1.0, 2.0, 3.0])]  # a repeated id
    v = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = lambda a: math.floor(256 * a) if abs(256 * a) < 2**52 else int(256 * a)
    kept = [(i, [whole(a) for a in e]) for i, e in rows if i != 151]
    want = brute_topk([i for i, _ in kept if i % 50 == 0], [e for i, e in kept if i % 50 == 0], [i for i, _ in kept], [e for _, e in kept], 5)
    for size in (1000, 17):  # ties and repeated ids across shards too
        got = sorted(map(tuple, top_k(v.where("id % 50 = 0"), v, block=8, shard_rows=size).collect()))
        assert got == [(i, n, j, clamped(s)) for i, n, j, s in want]


def test_top_k_over_spark(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 37 + j * 11) % 19 - 9) / 64 for j in range(4)], "x") for i in range(120)]
    rows += [(500, None, "x"), (550, [nan, 0.0, 0.0, 0.0], "x"), (600, [inf, 0.0, 0.0, 0.0], "x"), (650, [None, 0.0, 0.0, 0.0], "x"), (None, [0.1] * 4, "x")]
    rows += [rows[7], (700, [0.5, 0.25], "x"), (750, [], "x"), (751, [0.5, 0.5], "x")]
    v = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"))
    q = v.where("id % 50 = 0")
    for size in (1000, 13):
        got = sorted(map(tuple, top_k(q, v, block=8, shard_rows=size, query_rows=2 if size == 13 else 100).collect()))
        four = [(i, [math.floor(256 * float(np.float32(a))) for a in e]) for i, e, _ in rows[:120]]
        want = brute_topk([i for i, _ in four if i % 50 == 0], [e for i, e in four if i % 50 == 0], [i for i, _ in four], [e for _, e in four], 5)
        assert got == sorted([*want, (700, 1, 751, 128 * 128 + 64 * 128)])
    assert top_k(q.limit(0), v).count() == 0 and top_k(q, v.limit(0)).count() == 0


def test_topk_counts_every_row(spark, tmp_path):
    """Repeated rows, other vectors of the query's id and rows of null id are candidates; only the query's own row is not."""
    from plumbline.llm.queries import op10_topk
    from plumbline.llm.topk import top_k_of_rows

    r = random.Random(8)
    rows = [(i, [r.randrange(-40, 40) / 16 for _ in range(3)]) for i in range(1, 130)]
    rows += [rows[6]] * 9 + [rows[49]] * 2 + [(100, [2.0, -1.0, 0.5]), (0, [0.25, 0.0, -0.75]), (-50, [-2.0, 1.0, 1.0])] + [(None, [2.5, 2.5, s]) for s in (-2.5, 2.5, 2.5)]
    spark.createDataFrame([*rows, (150, None)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [[math.floor(256 * a) for a in e] for _, e in rows]
    want = []
    for n, (i, _) in enumerate(rows):
        if i is not None and i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(whole[n], v, strict=True)), j is None, j or 0) for m, (v, (j, _)) in enumerate(zip(whole, rows, strict=True)) if m != n)
            want += [(i, at + 1, None if unnamed else j, -score) for at, (score, unnamed, j) in enumerate(s[:5])]
    assert sorted(map(repr, (tuple(g) for g in op10_topk(spark, str(tmp_path)).collect()))) == sorted(map(repr, want))
    v = integer_vectors(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), null_ids=True)
    got = top_k_of_rows(v, F.col("id") % 50 == 0, block=4, shard_rows=5, query_rows=2).collect()  # heavy ids over several shards
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
