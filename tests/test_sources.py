"""Readers, parsers, sinks and streams on hand-written files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import detect as D
from plumbline.sources import files, parsers
from plumbline.streaming import events as S


def test_tsv_with_awkward_cells(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('repo\tn\tnote\r\nx\t1\t"quoted"\r\n\r\ny\t\t\r\nz\n')
    rows = files.read_tsv(spark, str(tmp_path / "a.tsv"), ["repo", "n", "note"]).collect()
    assert [tuple(r) for r in rows] == [("x", "1", '"quoted"'), ("y", "", ""), ("z", "", "")]
    d = spark.createDataFrame([("a\tb\nc", None), ("d", 2)], "s string, n int").coalesce(1)
    files.write_tsv(d, str(tmp_path / "out"), clean=True)
    assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "out"), ["s", "n"]).collect())) == [("a b c", ""), ("d", "2")]


def test_json_shapes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('[{"rule": "a", "line": 1},\n {"rule": "b", "line": 2}]')
    (tmp_path / "in" / "2.json").write_text('[{"rule": "c"}]')
    got = files.read_json_arrays(spark, str(tmp_path / "in"), "rule string, line int").collect()
    assert sorted((r["rule"], r["line"]) for r in got) == [("a", 1), ("b", 2), ("c", None)]
    (tmp_path / "bad.json").write_text("{oops")
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        files.read_json_arrays(spark, str(tmp_path / "bad.json"), "rule string").collect()
    (tmp_path / "k.json").write_text('{"r1": [{"line": 3}, {"line": 4}], "r2": []}')
    assert sorted(map(tuple, files.read_keyed_findings(spark, str(tmp_path / "k.json"), "line: int").collect())) == [("r1", 3), ("r1", 4)]


def test_source_tree_and_resume(spark, tmp_path):
    for name, text in {"a.js": "1", "node_modules/b.js": "2", "lib/c.ts": "3", "d.txt": "4", "big.py": "x" * 99}.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    got = files.source_tree(spark, str(tmp_path / "t"), max_bytes=50).collect()
    assert sorted(r["text"] for r in got) == ["1", "3"]
    d = spark.range(10)
    assert [files.append_missing(x, str(tmp_path / "r"), "id") for x in (d.limit(4), d, d)] == [4, 6, 0]
    assert files.markdown_table(spark.createDataFrame([("a|b", 1)], "s string, n int")).splitlines()[2] == "| a\\|b | 1 |"
    with pytest.raises(ValueError, match="more than 2"):
        files.markdown_table(d, 2)


def test_parsers(spark):
    md = "# Corpus\n## Web\n| Repo | Stars |\n|---|---|\n| [a](https://github.com/o/a) | 5 |\ntext https://github.com/o/no\n## Data\n| x | https://github.com/p/b.git |\n"
    rows = parsers.markdown_corpus(spark.createDataFrame([(1, md)], "k int, t string"), "k", "t").orderBy("no").collect()
    assert [(r["section"], r["repo"]) for r in rows] == [("Web", "o/a"), ("Data", "p/b")]
    prisma = "enum Role { A B }\nmodel User {\n id Int @id\n role Role?\n tags String[]\n posts Post[]\n at DateTime // x\n @@index([at(sort: Desc), id])\n}\n"
    assert parsers.parse_models(prisma)[0][3] == [["id"], ["at", "id"]]
    assert parsers.model_schema(prisma, "User") == T.StructType(
        [T.StructField("id", T.IntegerType(), False), T.StructField("role", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()), False), T.StructField("at", T.TimestampType(), False)]
    )
    blame = "a" * 40 + " 1 1 2\nauthor Ann\nauthor-time 10\nsummary s\n\tx\n" + "a" * 40 + " 2 2\nauthor Ann\nauthor-time 10\nsummary s\n\ty"
    assert parsers.parse_blame(blame) == [(1, "a" * 40, "Ann", 10, "s"), (2, "a" * 40, "Ann", 10, "s")]
    assert parsers.parse_models(None) == [] and parsers.parse_blame(None) == []


def test_detectors_on_awkward_sources(spark):
    for detect in (D.blocking_calls, D.ui_leaks, D.js_loops, D.python_loops, D.resource_calls, D.bundle_bloat, D.dom_patterns, D.payload_patterns, D.redos_patterns, D.cache_calls, D.query_fields, D.entity_columns):
        for text in ("", "(", "{{{", "for (", "'", "/*", "for (const a of b", "@Entity() class A", "[" * 50, "(?P<", "é" * 10):
            assert isinstance(detect(text), list)
    large = "const x = 1;\n" * 400_000 + "fs.statSync(a)"
    d = spark.createDataFrame([(1, None), (2, ""), (3, large), (4, "fs.readFileSync(a)")], "k int, t string")
    assert [(r["k"], r["line"]) for r in D.findings(d, "k", "t", D.blocking_calls).orderBy("k").collect()] == [(3, 400_001), (4, 1)]
    assert D.redos_class("(a+)+$")[1] == D.redos_class("(?<n>a+)+")[1] == "nested_quantifiers" and D.redos_class("(")[1] == "unreadable_pattern"
    assert D.redos_class("(ab|cd)") is None and D.redos_class("(ab|cd)", compat=True)[1] == D.redos_class("(a|b)", compat=True)[1] == "overlapping_alternatives"
    assert [f[1] for f in D.python_loops("for a in b:\n for c in d:\n  for e in f: pass")] == ["nested-loops", "nested-loops"]


def test_python_loops_names_and_depth():
    source = "for a in b:\n  re.escape(a)\n  re.match(a, b)\n  compile(a)\n  x.compile(a)\n  json.dumps(a)\n  y = [json.loads(c) for c in a]\nre.match(a, b)\n"
    assert [f[:2] for f in D.python_loops(source)] == [(3, "regex-in-loop"), (4, "regex-in-loop"), (7, "json-parse-in-loop"), (7, "nested-comprehension")]
    assert D.python_loops("x = " + "+".join(["1"] * 1500)) == []


def test_detectors_on_multi_line_sources():
    """Real-looking sources: what is in comments, strings and other functions does not count."""
    js = """// fs.readFileSync(a)
import moment from 'moment';
import { a,
  b } from '@mui/material';
const s = "for (const x of y) { JSON.parse(z) }";
function load(paths) {
  for (const p of paths) {
    /* fs.statSync(p) */
    if (fs.existsSync(p)) {
      const t = JSON.parse(read(p));
    }
  }
  const c = pool.getConnection();
  return c.query(q);
}
function save(c) { c.release(); }
items.filter(x => ok(x, [1])).map(y => y);
"""
    assert [f[:3] for f in D.blocking_calls(js)] == [(9, "blocking_file", "loop")]
    assert [f[:2] for f in D.js_loops(js)] == [(10, "json-parse-in-loop"), (17, "chained-array-methods")]
    assert [f[:2] for f in D.bundle_bloat(js)] == [(2, "moment_import"), (3, "barrel_import")]
    calls = {(f[0], f[1], f[3].split(":")[1]): f[3].split(":")[0] for f in D.resource_calls(js)}
    assert calls[(13, "unclosed_connection", "acquire")] != calls[(16, "unclosed_connection", "release")]


def test_detectors_are_linear():
    import time

    for part in ("for (const a of x) { f(a); }\n", "/*", '"', "import ", "\n", "function ", "x.map(", "{(["):
        for detect in D.RULES.values():
            took = []
            for n in (4000, 16_000):
                began = time.process_time()
                detect(part * n)
                took.append(time.process_time() - began)
            assert took[1] < 8 * took[0] + 1, (part, detect.__name__)


def test_rules_are_registered_once():
    D.register_rule("own", lambda text: [(1, "own", "low", text)])
    with pytest.raises(ValueError, match="twice"):
        D.register_rule("own", lambda text: [])
    del D.RULES["own"]


def test_globs():
    import re

    fits = lambda g, p: bool(re.fullmatch(files.glob_regex(g), p))
    assert fits("**/*.ts", "a.ts") and fits("**/*.ts", "x/y/a.ts") and not fits("*.ts", "x/a.ts") and fits("src/{a,b}.t?", "src/b.ts") and not fits("a.ts", "aXts")


def test_streams_match_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = S.windowed_counts(S.read_events(spark, str(tmp_path / "events")))
    got = {(r["start"], r["event_type"]): r["n"] for r in S.run_once(stream, "windows", str(tmp_path / "c1")).collect()}
    want = {(r["w"]["start"], r["event_type"]): r["n"] for r in e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 10
    s = S.run_once(S.sessions(S.read_events(spark, str(tmp_path / "events"))), "sessions", str(tmp_path / "c2"))
    assert s.filter("n < 1").count() == 0 and s.count() > 0
