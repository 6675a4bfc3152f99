"""Detectors over source texts. Each query writes a source per row of a table and scans them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators.regex_rules import regex_growth
from ..sources.parsers import schema_models
from ..sources.tables import Tables
from . import script_fixtures as fixtures
from .registry import query

C = F.col


def sources(t: Tables, *parts: str) -> DataFrame:
    """One source per part row, chosen in turn from `parts`."""
    text = F.get(F.array(*[F.lit(p) for p in parts]), (C("p_partkey") % len(parts)).cast("int"))
    return t.part.select("p_partkey", text.alias("text"))


def rules_sql(*rules: str) -> str:
    """The expected (key, rule) rows: `rules` lists, by turn, the rules of each source, comma-joined."""
    turns = ", ".join(f"'{r}'" for r in rules)
    return f"SELECT p_partkey, unnest(string_split([{turns}][p_partkey % {len(rules)} + 1], ',')) AS rule FROM part WHERE [{turns}][p_partkey % {len(rules)} + 1] <> ''"


def labelled(t: Tables, detect, sources_: list[fixtures.Labelled]) -> DataFrame:
    """Findings on a source a part, chosen in turn from the labelled ones."""
    return D.findings(sources(t, *[s for s, _ in sources_]), "p_partkey", "text", detect).select("p_partkey", "line", "rule")


def found(t: Tables, detect, *parts: str) -> DataFrame:
    return D.findings(sources(t, *parts), "p_partkey", "text", detect).select("p_partkey", "rule")


@query(fixtures.expected_sql(fixtures.placed(fixtures.BLOCKING)))
def det_01_blocking_io(t: Tables) -> DataFrame:
    return labelled(t, D.blocking_calls, fixtures.placed(fixtures.BLOCKING))


def hint(path: Column) -> Column:
    return D.blocking_context(*[D.path_hint(path, k) for k in ("tooling", "request", "background", "startup")])


def path_of() -> Column:
    parts = ["/src/tests/", "/src/routes/", "/src/jobs/", "/src/main.", "/src/lib/", "/Api\\tests\\"]
    return F.concat(F.get(F.array(*[F.lit(p) for p in parts]), (C("p_partkey") % 6).cast("int")), C("p_partkey").cast("string"), F.lit(".ts"))


CONTEXT = "['tooling_path', 'request_path', 'background_path', 'startup_path', 'unknown', 'tooling_path'][p_partkey % 6 + 1]"


@query(f"SELECT p_partkey, {CONTEXT} AS context FROM part")
def det_02_context(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", hint(path_of()).alias("context"))


@query(
    f"""SELECT p_partkey, CASE WHEN c = 'request_path' AND l THEN 'critical' WHEN c = 'request_path' THEN 'high' WHEN c = 'background_path' AND l THEN 'high' WHEN c = 'background_path' THEN 'medium'
      WHEN c IN ('startup_path', 'tooling_path') THEN 'low' WHEN l THEN 'high' ELSE 'medium' END AS severity FROM (SELECT p_partkey, {CONTEXT} AS c, p_size > 25 AS l FROM part)"""
)
def det_03_severity(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", hint(path_of()).alias("c"), "p_size").select("p_partkey", D.blocking_severity(C("c"), C("p_size") > 25).alias("severity"))


@query("SELECT p_partkey, ['path:tooling', 'path:request', 'path:background', 'path:startup', '', 'path:tooling,path:request'][p_partkey % 6 + 1] AS matched_by FROM part")
def det_04_path_hints(t: Tables) -> DataFrame:
    m = D.matched_by(**{f"path:{k}": D.path_hint(path_of(), k) for k in ("tooling", "background", "request", "startup")})
    return t.part.select("p_partkey", F.array_join(m, ",").alias("matched_by"))


@query(fixtures.expected_sql(fixtures.placed(fixtures.UI)))
def det_05_ui_leaks(t: Tables) -> DataFrame:
    return labelled(t, D.ui_leaks, fixtures.placed(fixtures.UI))


@query(fixtures.expected_sql(fixtures.placed(fixtures.LOOPS)))
def det_06_js_loops(t: Tables) -> DataFrame:
    return labelled(t, D.js_loops, fixtures.placed(fixtures.LOOPS))


@query(fixtures.expected_sql(fixtures.PYTHON))
def det_07_python_loops(t: Tables) -> DataFrame:
    return labelled(t, D.python_loops, fixtures.PYTHON)


MODEL = "model Post {\n  id Int @id\n  userId Int\n  user User @relation(fields: [userId], references: [id])\n  createdAt DateTime\n  title String\n%s}\n"


@query("SELECT p_partkey, rule, field FROM (SELECT p_partkey, unnest(['missing-fk-index', 'missing-sort-index']) AS rule, unnest(['userId', 'createdAt']) AS field FROM part) WHERE (p_partkey % 3 = 0) OR (p_partkey % 3 = 1 AND rule = 'missing-sort-index')")
def det_08_schema_indexes(t: Tables) -> DataFrame:
    docs = sources(t, MODEL % "", MODEL % "  @@index([userId])\n", MODEL % "  @@index([userId])\n  @@index([createdAt])\n")
    return D.index_issues(schema_models(docs, "p_partkey", "text"), "p_partkey").select("p_partkey", "rule", "field")


@query("SELECT p_partkey, issue, field FROM (SELECT p_partkey, unnest(['missing-filter-index', 'missing-composite-index']) AS issue, unnest(['title', 'userId,title']) AS field FROM part) WHERE p_partkey % 2 = 0")
def det_08_query_indexes(t: Tables) -> DataFrame:
    schema = t.spark.createDataFrame([(1, MODEL % "  @@index([userId])\n")], "k int, text string")
    calls = sources(t, "const a = await prisma.post.findMany({ where: { userId: 1, title: 'x' } });", "prisma.post.findMany({ where: { userId: 1 } })")
    queries = D.findings(calls, "p_partkey", "text", D.query_fields)
    return D.query_issues(queries, schema_models(schema, "k", "text").drop("k", "line"), "p_partkey").select("p_partkey", "issue", "field")


@query(rules_sql("missing-relation-index", ""))
def det_09_entities(t: Tables) -> DataFrame:
    return found(t, D.entity_columns, "@Entity()\nexport class A {\n  @ManyToOne(() => B)\n  owner: B;\n}", "@Entity()\nexport class A {\n  @Index()\n  @ManyToOne(() => B)\n  owner: B;\n}")


@query(fixtures.expected_sql(fixtures.placed(fixtures.LEAKS)))
def det_10_resource_leaks(t: Tables) -> DataFrame:
    docs = sources(t, *[s for s, _ in fixtures.placed(fixtures.LEAKS)])
    return D.resource_leaks(D.findings(docs, "p_partkey", "text", D.resource_calls), "p_partkey").select("p_partkey", "line", "rule")


@query(fixtures.expected_sql(fixtures.placed(fixtures.IMPORTS, only=fixtures.TOP)))
def det_11_bundle_bloat(t: Tables) -> DataFrame:
    return labelled(t, D.bundle_bloat, fixtures.placed(fixtures.IMPORTS, only=fixtures.TOP))


@query(fixtures.expected_sql(fixtures.placed(fixtures.DOM)))
def det_12_dom_patterns(t: Tables) -> DataFrame:
    return labelled(t, D.dom_patterns, fixtures.placed(fixtures.DOM))


@query(fixtures.expected_sql(fixtures.placed(fixtures.PAYLOADS, strings=True)))
def det_13_payloads(t: Tables) -> DataFrame:
    return labelled(t, D.payload_patterns, fixtures.placed(fixtures.PAYLOADS, strings=True))


def pattern_rows(found: list[tuple[str, str]]) -> str:
    """The expected rows of patterns by turn; an empty word is no row."""
    return f"SELECT p_partkey, e.pattern, e.found FROM part JOIN (VALUES {fixtures.values_sql([(i, p, w) for i, (p, w) in enumerate(found) if w])}) AS e(i, pattern, found) ON p_partkey % {len(found)} = e.i"


def patterns(t: Tables) -> DataFrame:
    return sources(t, *[p for p, *_ in fixtures.PATTERNS])


@query(pattern_rows([(p, rule) for p, rule, _ in fixtures.PATTERNS]))
def det_14_redos(t: Tables) -> DataFrame:
    docs = patterns(t)
    rules = D.findings(docs, "p_partkey", "text", D.redos_patterns).select("p_partkey", C("rule").alias("found"))
    return docs.join(rules, "p_partkey").select("p_partkey", C("text").alias("pattern"), "found")


@query(pattern_rows([(p, growth) for p, _, growth in fixtures.PATTERNS]))
def det_14_growth(t: Tables) -> DataFrame:
    """How many ways of matching a pattern has as texts grow."""
    docs = patterns(t)
    growth = D.findings(docs, "p_partkey", "text", lambda p: [(1, regex_growth(p), "", "")]).select("p_partkey", C("rule").alias("found"))
    return docs.join(growth, "p_partkey").select("p_partkey", C("text").alias("pattern"), "found")


@query(
    f"""SELECT p_partkey, e.rule, e.signature, e.n::BIGINT AS n FROM part
      JOIN (VALUES {fixtures.values_sql([(i, *f) for i, (_, labels) in enumerate(fixtures.CACHE) for f in labels])}) AS e(i, rule, signature, n) ON p_partkey % {len(fixtures.CACHE)} = e.i"""
)
def det_15_cache_opportunities(t: Tables) -> DataFrame:
    docs = sources(t, *[s for s, _ in fixtures.CACHE])
    return D.repeated_calls(D.findings(docs, "p_partkey", "text", D.cache_calls), "p_partkey").select("p_partkey", "rule", "signature", "n")


@query("SELECT p_partkey, ['test', 'route', 'service', 'repository', 'other', 'route'][p_partkey % 6 + 1] AS layer FROM part")
def det_16_layer(t: Tables) -> DataFrame:
    paths = ["src/a.test.ts", "src/routes/x.ts", "src/user/service.ts", "src/storage/x.ts", "src/lib/x.ts", "src/lib/y.ts"]
    path = F.get(F.array(*[F.lit(p) for p in paths]), (C("p_partkey") % 6).cast("int"))
    content = F.when(C("p_partkey") % 6 == 5, "app.get('/x', f)").otherwise("const a = 1")
    return t.part.select("p_partkey", D.source_layer(path, content).alias("layer"))


@query("SELECT p_partkey, ['prisma', 'sequelize,knex', ''][p_partkey % 3 + 1] AS orms FROM part")
def det_17_orm_signals(t: Tables) -> DataFrame:
    docs = sources(t, '{"dependencies": {"prisma": "1", "x": "2"}}', '{"dependencies": {"knex": "1"}, "devDependencies": {"sequelize": "2"}}', "{}")
    return docs.select("p_partkey", F.array_join(D.orm_signals(C("text")), ",").alias("orms"))


@query("SELECT source, arg_max(lang, (n, lang)) AS main, max(n) * 100.0::DOUBLE / sum(n) < 70 AS is_mixed FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def det_18_primary_language(t: Tables) -> DataFrame:
    n = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("main"), (F.max("n") * 100.0 / F.sum("n") < 70).alias("is_mixed"))


@query("SELECT p_partkey, ['vue', 'react', 'angular', 'unknown'][p_partkey % 4 + 1] AS framework FROM part")
def det_20_framework(t: Tables) -> DataFrame:
    docs = sources(t, "import { ref } from 'vue'", "import React from 'react'", "import x from 'vue'", "const a = 1")
    heading = F.when(C("p_partkey") % 4 == 2, "Angular apps").otherwise("Other")
    return docs.select("p_partkey", D.framework(heading, C("text")).alias("framework"))
