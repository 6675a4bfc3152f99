"""Trees, paged services, resumed scans, commit graphs, corpus files, replayed draws and ranges."""

from __future__ import annotations

import json
import os
import random
import zlib

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from plumbline.functions.rules import gzip_length, in_locale
from plumbline.operators.history import first_parents, last_before, reachable
from plumbline.operators.sampling import replayed_sample, replayed_ranks
from plumbline.operators.windows import range_of
from plumbline.sources import connectors, files, parsers


def make_tree(root, paths):
    for p in paths:
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(f"text of {p}")


TREE = ["a.ts", "src/b.ts", "src/deep/er/c.js", "src/node_modules/x/y/z.ts", "node_modules/p/q.ts", "docs/d.md", "src/deep/dist/e.ts", "src/large.ts"]


def test_skipped_folders_are_never_opened(spark, tmp_path, monkeypatch):
    make_tree(tmp_path, TREE)
    with open(f"{tmp_path}/src/large.ts", "w") as f:
        f.write("x" * 2000)
    entered = []
    plain = connectors.opened
    monkeypatch.setattr(connectors, "opened", lambda fs, root, folder, rules: (entered.append(folder), plain(fs, root, folder, rules))[1])
    reader = connectors.TreeReader({"path": str(tmp_path), "extensions": "ts,js", "maxbytes": "1000", "parts": "2"})
    found = [p for part in reader.partitions() for b in reader.read(part) for p in b.column(0).to_pylist()]
    assert sorted(found) == ["a.ts", "src/b.ts", "src/deep/er/c.js"]
    assert sorted(entered) == ["", "docs", "src", "src/deep", "src/deep/er"]  # each once, none below a skipped one
    rows = files.source_tree(spark, str(tmp_path), "ts,js", max_bytes=1000).collect()
    assert {r["path"]: r["text"] for r in rows} == {p: f"text of {p}" for p in ("a.ts", "src/b.ts", "src/deep/er/c.js")}


def test_globs_and_ignored_folders(spark, tmp_path):
    make_tree(tmp_path, TREE)
    got = lambda *a: sorted(r["path"] for r in files.glob_scan(spark, str(tmp_path), *a).collect())
    assert got("**/*.{ts,js}", ["**/node_modules/**", "src/deep/dist/**"]) == ["a.ts", "src/b.ts", "src/deep/er/c.js", "src/large.ts"]
    assert got("src/*.ts") == ["src/b.ts", "src/large.ts"] and got("*.md") == []
    rules = connectors.TreeRules({"ignore": "**/node_modules/**", "skip": ""})
    assert not rules.enters("src/node_modules") and rules.enters("src/modules")
    assert [p for p in got("**", ["src/**"])] == ["a.ts", "docs/d.md", "node_modules/p/q.ts"]


def answers(root, ranges, items, page_size, refused=()):
    for low, high in ranges:
        own = [i for i in items if low <= i["size"] <= high]
        os.makedirs(f"{root}/low={low}/high={high}", exist_ok=True)
        with open(f"{root}/low={low}/high={high}/x.json", "w") as f:
            for page in range(1, max(1, -(-len(own) // page_size)) + 1):
                bad = (low, page) in refused
                for attempt in ([1] if bad else []):
                    f.write(json.dumps({"page": page, "attempt": attempt, "status": 503}) + "\n")
                f.write(json.dumps({"page": page, "attempt": 2 if bad else 1, "status": 200, "total": len(own), "items": own[(page - 1) * page_size : page * page_size]}) + "\n")


def test_capped_ranges_are_split(spark, tmp_path):
    items = [{"id": i, "size": i % 8} for i in range(40)]
    answers(tmp_path, [(0, 7), (0, 3), (4, 7), (0, 1), (2, 3), (4, 5), (6, 7)], items, 4, {(0, 2), (4, 1)})
    df = files.paged_service(spark, str(tmp_path), 7, cap=12, page_size=4, wait=0)
    rows = df.collect()
    assert sorted(json.loads(r["item"])["id"] for r in rows) == list(range(40))
    assert {(r["low"], r["high"]) for r in rows} == {(0, 1), (2, 3), (4, 5), (6, 7)} and df.rdd.getNumPartitions() == 4
    assert {(r["low"], r["page"]) for r in rows if r["retries"]} == {(0, 2), (4, 1)}
    with pytest.raises(Exception, match="split by another key"):
        answers(tmp_path, [(0, 0), (1, 1)], items, 4)
        files.paged_service(spark, str(tmp_path), 7, cap=4, page_size=4, wait=0).collect()
    with pytest.raises(Exception, match="status 503 at attempt 1"):
        files.paged_service(spark, str(tmp_path), 7, cap=12, page_size=4, wait=0, tries=1).collect()


def test_a_broken_scan_goes_on(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    for k in range(7):
        with open(f"{tmp_path}/in/{k}.txt", "w") as f:
            f.write(f"file {k}")
    where = (f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/progress")
    seen = []

    def scan(df):
        seen.append(sorted(r["value"] for r in df.collect()))
        if len(seen) == 3:
            raise OSError("stopped")
        return df.select("value")

    with pytest.raises(Exception, match="stopped"):
        files.resumable_scan(spark, *where, scan, files_at_once=2)
    done = files.resumable_scan(spark, *where, scan, files_at_once=2)
    assert sorted(r["value"] for r in done.collect()) == [f"file {k}" for k in range(7)]
    assert seen[3] == seen[2] and sum(map(len, seen)) == 7 + len(seen[2])  # only the broken batch is scanned again
    with open(f"{tmp_path}/in/new.txt", "w") as f:
        f.write("file new")
    assert files.resumable_scan(spark, *where, scan, files_at_once=2).count() == 8 and seen[-1] == ["file new"]


def test_commit_graphs(spark):
    r = random.Random(3)
    edges, want, heads, chains = [], set(), [], set()
    for g in range(6):
        parents = {1: []}
        for c in range(2, 60):
            parents[c] = [max(1, c - r.choice([1, 1, 1, 1, 5]))] + ([r.randrange(1, c)] if r.random() < 0.12 else [])
        edges += [(g, c, p, k == 0) for c, ps in parents.items() for k, p in enumerate(dict.fromkeys(ps))]
        head = 59 if g else 40
        heads.append((g, head))
        todo, seen = [head], set()
        while todo:
            c = todo.pop()
            if c not in seen:
                seen.add(c)
                todo += parents[c]
        want |= {(g, c) for c in seen}
        c, d = head, 0
        while True:
            chains.add((g, c, d))
            if not parents[c]:
                break
            c, d = parents[c][0], d + 1
    e = spark.createDataFrame(edges, "graph int, commit long, parent long, first boolean")
    h = spark.createDataFrame(heads, "graph int, commit long")
    got = [tuple(x) for x in reachable(e, h).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    chain = first_parents(e, h)
    assert {(x["graph"], x["commit"], x["distance"]) for x in chain.collect()} == chains
    times = spark.createDataFrame([(g, c, c * 10) for g in range(6) for c in range(1, 60)], "graph int, commit long, time long")
    pinned = {x["graph"]: x["commit"] for x in last_before(chain, times, F.lit(305)).collect()}
    assert pinned == {g: max(c for g2, c, _ in chains if g2 == g and c * 10 <= 305) for g in range(6)}
    assert last_before(chain, times, F.lit(5)).count() == 0


def test_corpus_tables(spark):
    text = "\n".join([
        "# Corpus", "", "## Domain 3 — Data (2 repos)", "", "| # | Repository | Notes | URL | Stars |", "|---|:-:|---|---|--:|", "| 1 | o/a | x \\| y | https://example.org/o/a.git | 5k |",
        "| 2 | o/b | `p|q` | https://example.org/o/b/ | |", "| 3 | none | no link | - | 1 |", "", "Text https://example.org/o/t here", "- [o/c](https://example.org/o/c) fine", "## Next", "| https://example.org/o/d | 7 |",
    ])
    rows = parsers.corpus_rows(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").orderBy("no").collect()
    got = [(r["section"], r["kind"], r["index"], r["repo"], r["url"], r["stars"], r["notes"]) for r in rows]
    assert got == [
        ("Data", "table", 1, "o/a", "https://example.org/o/a", "5k", "x | y"), ("Data", "table", 2, "o/b", "https://example.org/o/b", None, "`p|q`"),
        ("Data", "bullet", None, "o/c", "https://example.org/o/c", None, None), ("Next", "table", None, "o/d", "https://example.org/o/d", None, None),
    ]


def plain_shuffle(size, seed):
    def draw():
        nonlocal seed
        seed = (seed + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((seed ^ (seed >> 15)) * (seed | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    out = list(range(size))
    for i in range(size - 1, 0, -1):
        j = int(draw() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def test_replayed_ranks(spark):
    for size, n, seed, block in ((1, 1, 1, 8), (2, 2, 5, 8), (25, 10, 42, 8), (1000, 60, 9, 64), (1000, 1000, 9, 1 << 16), (5000, 3, 1, 100), (0, 4, 1, 8)):
        assert replayed_ranks(size, n, seed, block) == plain_shuffle(size, seed)[:n]
    drawn = replayed_sample(spark.range(10, 5010).toDF("k"), "k", 20, 77).orderBy("pos").collect()
    assert [r["k"] for r in drawn] == [10 + x for x in plain_shuffle(5000, 77)[:20]]


def test_ranges_of_sorted_cuts(spark):
    r = random.Random(1)
    for n in (0, 1, 2, 3, 10, 50, 700):
        cuts = sorted({r.uniform(0, 100) for _ in range(n)})
        values = [r.uniform(-5, 105) for _ in range(200)] + cuts[:20]
        rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", range_of(F.col("v"), cuts).alias("r")).collect()
        assert all(x["r"] == sum(c < x["v"] for c in cuts) for x in rows)


def test_gzip_lengths_and_locale(spark):
    texts = ["", "a", "word " * 5000, "é漢😀", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", gzip_length("t").alias("n")).collect()
    for r in rows:
        t = texts[r["i"]]
        assert r["n"] == (None if t is None else len(zlib.compress(t.encode(), 6)) - 6 + 18)  # zlib wraps the same data in six bytes, gzip in eighteen
    names = ["b", "A", "a", "É", "e", "Z", "é", "ab", "a-b", "B"]
    got = [r["x"] for r in spark.createDataFrame([(n,) for n in names], "x string").orderBy(in_locale(F.col("x")), "x").collect()]
    assert got == ["a", "A", "a-b", "ab", "b", "B", "e", "é", "É", "Z"]


def test_trees_use_any_file_system(tmp_path):
    fs, at = connectors.file_system(f"file://{tmp_path}")
    assert isinstance(fs, pyarrow.fs.FileSystem) and at == str(tmp_path)
    assert connectors.file_system(f"file:{tmp_path}")[1] == str(tmp_path)
