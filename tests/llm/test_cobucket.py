from __future__ import annotations

import datetime
import glob
import hashlib
import math
import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import queries
from plumbline.llm.cobucket import RowKeys, bucket_of, co_bucket
from plumbline.llm.token_files import new_folder


def order(row):
    """Nulls first, zeros equal, NaN last, text by UTF-8 bytes."""

    def one(v):
        if v is None:
            return (0,)
        if isinstance(v, float):
            return (1, math.isnan(v), 0.0 if math.isnan(v) else v + 0.0)
        return (1, v.encode() if isinstance(v, str) else v)

    return tuple(map(one, row))


def exact(row):
    return tuple(("nan" if math.isnan(v) else struct.pack(">d", v)) if isinstance(v, float) else v for v in row)


VALUES = st.tuples(
    st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)),
    st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("a\0\x01zé😀")), max_size=4)),
    st.one_of(st.none(), st.floats()),
    st.one_of(st.none(), st.sampled_from([0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -1.5])),
    st.one_of(st.none(), st.booleans()),
    st.one_of(st.none(), st.integers(-5, 5)),
)


@settings(max_examples=200, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=12))
def test_row_keys_sort_as_rows_and_come_back(rows):
    schema = pa.schema([("a", pa.int64()), ("s", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("b", pa.bool_()), ("n", pa.int32())])
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
    keys = RowKeys(schema).encode(columns, np.zeros((len(rows), 4), dtype=np.uint8), 2)
    back = RowKeys(schema).decode([k[4:13] + k[14:] for k in keys], 0)
    assert [exact(r.values()) for r in back.to_pylist()] == [exact(r) for r in rows]
    pairs = sorted(zip(keys, rows, strict=True), key=lambda p: p[0])
    assert [order(r) for _, r in pairs] == sorted(order(r) for r in rows)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def facts_plainly(sales, lines, buckets, start_sale, start_line):
    """(table, bucket) -> columns of the result that do not name a path, and the bucket's rows, by loops over lists."""
    ids = Counter(s[0] for s in sales if s[0] is not None)
    b_of = lambda i: buckets + 1 if i is None else zlib.crc32(f"line{i}".encode()) % buckets
    out = {}
    joined = Counter()
    for table, rows, start in (("sales", sales, start_sale), ("sale_lines", lines, start_line)):
        into, total = defaultdict(list), Counter()
        for r in rows:
            b = b_of(r[0])
            if table == "sale_lines" and r[0] is not None:
                joined[b] += ids[r[0]]
                b = b if ids[r[0]] else buckets
            into[b].append((r, start(r)))
            total[start(r)] += 1
        for b, got in into.items():
            got.sort(key=lambda x: order(x[0]))
            line = Counter(s for _, s in got)
            stays = len(line) == 1 and total[got[0][1]] == len(got)
            out[table, b] = {
                "ids_sha256": sha(",".join("" if r[0] is None else str(r[0]) for r, _ in got)), "lineage_sha256": sha(",".join(f"{s}:{line[s]}" for s in sorted(line))),
                "n_rows": len(got), "rewritten": not stays, "rows": [exact(r) for r, _ in got],
            }
    for (_, b), f in out.items():
        f["n_joined"] = joined[b] if b < buckets else 0
    return out


def check(result, sales, lines, buckets, start_sale, start_line, columns):
    rows = result.collect()
    want = facts_plainly(sales, lines, buckets, start_sale, start_line)
    assert {(r["table_name"], r["bucket"]) for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        w = want[r["table_name"], r["bucket"]]
        assert {k: r[k] for k in w if k != "rows"} == {k: v for k, v in w.items() if k != "rows"}, r
        assert r["columns"] == ",".join(columns[r["table_name"]])
        assert "=" not in r["path"]  # readers would take it for a column
        table = pq.read_table(r["path"].removeprefix("file://"))
        assert table.column_names == columns[r["table_name"]]
        got = [tuple(v.values()) for v in table.to_pylist()]
        assert [order(x) for x in got] == sorted(map(order, got))
        assert sorted(map(repr, map(exact, got))) == sorted(map(repr, w["rows"]))
    return rows


def test_whole_query_against_loops(spark, sf):
    sales, lines = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()] for t in ("sales", "sale_lines"))
    b = lambda i: 301 if i is None else zlib.crc32(f"line{i}".encode()) % 300
    rows = check(
        queries.op12_co_buckets(spark, sf), sales, lines, 300, lambda r: b(r[0]) - (b(r[0]) % 3 == 1), lambda r: 0 if r[2] is None else zlib.crc32(str(r[2]).encode()) % 300,
        {t: spark.read.parquet(f"{sf}/{t}.parquet").columns for t in ("sales", "sale_lines")},
    )
    assert any(not r["rewritten"] for r in rows) and any(r["rewritten"] for r in rows)
    root = rows[0]["path"].removeprefix("file://").split("/sales/")[0].split("/sale_lines/")[0]
    files = {f for d, _, fs in os.walk(root) for f in (f"{d}/{x}" for x in fs)}
    assert files == {r["path"].removeprefix("file://") for r in rows}


def test_hot_key_orphans_nulls_and_repeats(spark):
    r = random.Random(5)
    when = datetime.datetime(2024, 1, 1)
    sales = [(i, r.choice(["x", "y", None, "é"]), r.choice([0.0, -0.0, 1.5, None, math.nan])) for i in range(120)] + [(7, "x", 1.0)] * 300 + [(None, None, None)] * 3
    lines = [(7 if k % 3 == 0 else r.choice([*range(200), None]), r.randrange(9), r.choice([None, "a", "b\0c", "ü"]), when if k % 5 else None, r.choice([True, None])) for k in range(2500)]
    kinds = ("sale_id long, status string, total double", "sale_id long, item long, bucket string, file timestamp_ntz, ok boolean")
    start_sale, start_line = (lambda x: (x[0] or 0) % 4), (lambda x: x[1])
    result = co_bucket(
        spark.createDataFrame(sales, kinds[0]).repartition(3), spark.createDataFrame(lines, kinds[1]).repartition(5), "sale_id", new_folder(spark, "test-buckets"), ("sales", "sale_lines"),
        F.coalesce(F.col("sale_id"), F.lit(0)) % 4, F.col("item"), buckets=20,
    )
    check(result, sales, lines, 20, start_sale, start_line, {"sales": ["sale_id", "status", "total"], "sale_lines": ["sale_id", "item", "bucket", "file", "ok"]})


def test_starting_file_that_is_a_final_file_stays(spark):
    """All lines of a sale lie in one file of another number: it stays; so does one of lines without a sale."""
    sales, lines = [(1, 1), (2, 2)], [(1, 5), (1, 5), (1, 5), (900, 6), (901, 6), (2, 7), (2, 8)]
    folder = new_folder(spark, "test-buckets")
    df = co_bucket(spark.createDataFrame(sales, "sale_id long, v int"), spark.createDataFrame(lines, "sale_id long, item int"), "sale_id", folder, ("sales", "sale_lines"), F.lit(0), F.col("item"), buckets=50)
    rows = check(df, sales, lines, 50, lambda r: 0, lambda r: r[1], {"sales": ["sale_id", "v"], "sale_lines": ["sale_id", "item"]})
    assert sum(not r["rewritten"] for r in rows if r["table_name"] == "sale_lines") == 2
    assert len(glob.glob(f"{folder.removeprefix('file://')}/**/*.parquet", recursive=True)) == len(rows)


def test_empty_tables(spark):
    sales, lines = spark.createDataFrame([], "sale_id long, v int"), spark.createDataFrame([(None, 1), (3, 1)], "sale_id long, item int")
    args = ("sale_id", ("sales", "sale_lines"))
    for s, n, want in ((sales, lines, 2), (sales, lines.limit(0), 0), (lines.select("sale_id", F.col("item").alias("v")), lines.limit(0), 2)):
        df = co_bucket(s, n, args[0], new_folder(spark, "test-buckets"), args[1], F.lit(0), F.col("item"), buckets=10)
        assert df.count() == want
    assert spark.range(3).select(bucket_of(F.col("id"), 300, "line").alias("b")).collect()[1]["b"] == zlib.crc32(b"line1") % 300
