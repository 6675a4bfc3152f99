from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import queries
from plumbline.llm.prefix_trie import Sweep, common_turns, prefix_trie, stitch

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt_plainly(rows):
    """conv_id -> list of (role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def trie_plainly(convs):
    """All nodes by the definition: a dictionary of prefixes."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in children[p])
        ends = sorted(c for c in members[p] if len(convs[c]) == len(p))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], sha))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_whole_query_against_all_prefixes(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = trie_plainly(rebuilt_plainly(rows))
    assert got(queries.op13_prefix_trie(spark, sf)) == want
    assert sum(1 for w in want if w[4] > 1) > 1


def random_rows(seed, n=300):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn if r.random() > 0.05 else None, r.choice(["user", "assistant", None]), r.choice(["a", "b b", "c c c", "", None, " x\ty "])))
    return rows


def test_ranges_pieces_and_waiting_children(spark):
    """The same trie whatever the number of ranges, with children that meet their parents by a join and id lists in pieces."""
    rows = random_rows(3)
    rows += [(1000 + 20 * i, 0, "user", "same") for i in range(400)] + [(1000 + 20 * i, 1, "user", "reply") for i in range(400)]
    want = trie_plainly(rebuilt_plainly(rows))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, waiting, piece in ((1, 50_000, 1 << 20), (23, 2, 16), (7, 1, 40)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert got(prefix_trie(spark.createDataFrame(rows, TURNS), waiting=waiting, piece=piece)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    long = " ".join(["word"] * 40_000)
    rows = [
        (0, 0, "user", "hi"), (0, 0, "user", "hi"), (0, None, None, None), (0, 1, "a", long),
        (None, 0, "user", "hi"), (7, 5, "user", "hi"), (19, 0, "", ""), (41, 0, "user", "only turn"), (46, 2, None, long), (-3, 0, "user", "hi"),
        *[(60, i, "user", f"t{i % 3}") for i in range(500)],
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"{TURNS}, key string, words int")
    assert got(prefix_trie(df)) == trie_plainly(rebuilt_plainly(rows))
    assert prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    only = prefix_trie(spark.createDataFrame([(41 + 20 * i, 0, "user", "only turn") for i in range(40)], TURNS)).collect()
    assert {r["depth"] for r in only} == {0, 1}  # some keep their turn, others are turnless as their shared begin is absent
    root = next(r for r in only if r["depth"] == 0)
    assert root["n_convs"] == 40 and root["parent_conv_id"] is None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=4), min_size=1, max_size=12), st.lists(st.integers(0, 12), max_size=4), st.integers(1, 3))
def test_stitched_ranges_give_each_node_once(convs, cuts, waiting):
    digest = lambda t: hashlib.md5(str(t).encode()).digest()
    rows = sorted((b"".join(digest(t) for t in turns), c, turns) for c, turns in enumerate(convs))
    bounds = sorted({0, len(rows), *(min(c, len(rows)) for c in cuts)})
    out = []
    for at, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        s = Sweep(at, waiting, 3)
        for key, c, turns in rows[a:b]:
            s.take(c, key, [t + 1 for t in turns])
        s.close()
        out += s.out
    edges, parents = stitch([r for r in out if r["kind"] == "part"])
    of = {(r, n): c for r, n, c in parents} | {(r["range"], r["number"]): r["conv_id"] for r in out if r["kind"] == "parent"}
    ends = defaultdict(list)
    for r in out:
        if r["kind"] == "end":
            ends[r["end_key"]] += [x for x in r["ids"].split(",") if x]
    nodes = [r for r in out if r["kind"] == "node"] + edges
    sha = lambda r: hashlib.sha256(",".join(ends[r["end_key"]]).encode()).hexdigest() if r.get("end_key") else r["ends_sha256"]
    parent = lambda r: of[r["range"], r["parent_number"]] if r.get("parent_number") else r["parent_conv_id"]
    want = trie_plainly({c: [("", " ".join(["w"] * (t + 1))) for t in turns] for c, turns in enumerate(convs)})
    assert sorted(((r["conv_id"], r["depth"], parent(r), r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], sha(r)) for r in nodes), key=repr) == want


def test_common_turns():
    a = bytes(range(64))
    assert common_turns(a, a) == 4 and common_turns(a, b"") == 0 and common_turns(a, a[:32]) == 2
    assert common_turns(a, a[:33] + b"\xff" * 31) == 2
