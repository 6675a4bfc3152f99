"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

from .test_dups_decontam_secrets import plain_components, plain_fingerprint, plain_hits, plain_secrets


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The small tables with awkward rows added."""
    path = str(tmp_path_factory.mktemp("corpus"))
    d = spark.read.parquet(f"{sf}/documents.parquet")
    text = "The quick brown fox jumps over the lazy dog, then password=hunter2hunter2 leaks to the open world of all the readers"
    first = d.orderBy("doc_id").first()["text"]
    odd = [(9001, None, None, None, None), (9002, "", "en", "z", 0), (9003, "123 !", "en", "z", 5), (9004, text, "en", "z", len(text)), (9004, text, "en", "z", len(text)), (None, text + " x", "en", None, 9), (9005, first, "en", "z", len(first))]
    d.unionByName(spark.createDataFrame(odd, d.schema)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_the_columns_and_match_the_plain_way(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    out = docs
    for name, stage in cp.STAGES[:-1]:
        before = [tuple(r) for r in out.select(*columns).collect()]
        out = spark.createDataFrame(stage(spark, out, folder).select(*columns).collect(), docs.schema)
        after = [tuple(r) for r in out.collect()]
        assert out.columns == columns
        key = lambda r: (r[0] is not None, r[0], r[1] or "")
        if name == "language_id":
            lettered = [r for r in before if r[1] and re.search(r"[^\W\d_]", r[1])]
            assert {r[1] for r in after} <= {r[1] for r in lettered} and len(after) >= len(lettered) - 2
        elif name == "near_dedup":
            root = plain_components([plain_fingerprint(r[1]) for r in before])
            groups = defaultdict(list)
            for r in before:
                groups[root[plain_fingerprint(r[1])]].append(r)
            want = []
            for g in groups.values():
                known = [r for r in g if r[0] is not None]
                least = min((r[0] for r in known), default=None)
                want.append(min((r for r in g if r[0] == least), key=lambda r: tuple((v is not None, v) for v in r)))
            assert sorted(after, key=key) == sorted(want, key=key)
        elif name == "decontaminate":
            keep = []
            for r in before:
                n, h, _ = plain_hits(r[1], bench)
                if not (h and 20 * h >= n):
                    keep.append(r)
            assert sorted(after, key=key) == sorted(keep, key=key)
        else:
            assert len(after) == len(before)
            for r in after:
                assert not plain_secrets(r[1]) and r[4] == len(r[1])
            untouched = [r for r in before if not plain_secrets(r[1])]
            assert {r[1] for r in untouched} <= {r[1] for r in after}
    mixed = cp.STAGES[-1][1](spark, out, folder)
    assert mixed.where("taken > 2 * size or taken <= 0").count() == 0


def test_run_and_empty_tables(spark, folder, tmp_path):
    got = cp.run(spark, folder)
    again = cp.run(spark, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    assert cp.ORACLE_SQL is None
    assert cp.run(spark, folder).where(F.col("target") < 0).count() == 0


def test_run_leaves_only_what_its_result_reads(spark, folder):
    at = f"{spark.conf.get('spark.checkpoint.dir')}/plumbline"
    before = set(os.listdir(at))
    got = cp.run(spark, folder)
    left = {d.rpartition("-")[0] for d in set(os.listdir(at)) - before}
    assert "stage-scan_secrets" in left
    assert not left & {"stage-language_id", "stage-near_dedup", "stage-decontaminate", "links", "fingerprints", "groups", "stay", "candidates", "ownership", "hits", "numbered"}, left
    assert got.count() > 0
