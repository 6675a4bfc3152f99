"""Sources, parsers and sinks, each over whole tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prng import mulberry_sql
from ..operators.history import first_parents, last_before, reachable
from ..sources import files, parsers
from ..sources.tables import Tables
from .registry import query

C = F.col


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def src_01_tsv(t: Tables) -> DataFrame:
    path = files.scratch_path(t.spark, "tsv")
    files.write_tsv(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), path)
    return files.read_tsv(t.spark, path, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS lang FROM documents")
def src_02_tsv_missing(t: Tables) -> DataFrame:
    """A missing cell stays null."""
    path = files.scratch_path(t.spark, "tsv")
    files.write_tsv(t.documents.select("doc_id", F.when(C("lang") != "fr", C("lang")).alias("lang")), path)
    return files.read_tsv(t.spark, path, ["doc_id", "lang"], None)


@query("SELECT event_id, event_type FROM events")
def src_04_json_folder(t: Tables) -> DataFrame:
    """A folder of JSON arrays of at most fifty records each."""
    path = files.scratch_path(t.spark, "json")
    chunk = F.floor(C("event_id") / 50)
    t.events.groupBy(chunk.alias("c")).agg(F.to_json(F.collect_list(F.struct("event_id", "event_type"))).alias("value")).select("value").write.text(path)
    rows = t.spark.read.text(path).select(F.explode(F.from_json("value", "array<struct<event_id: bigint, event_type: string>>")).alias("e"))
    return rows.select("e.*")


@query("SELECT o_custkey::VARCHAR AS repo, o_orderkey AS line FROM orders")
def src_05_keyed_findings(t: Tables) -> DataFrame:
    """Objects {repo: [finding]}; a repository's findings come in runs, so no object grows without bound."""
    path = files.scratch_path(t.spark, "keyed")
    per = t.orders.groupBy(C("o_custkey").cast("string").alias("repo"), F.floor(C("o_orderkey") / 1000)).agg(F.collect_list(F.struct(C("o_orderkey").alias("line"))).alias("f"))
    per.select(F.to_json(F.map_from_arrays(F.array("repo"), F.array("f"))).alias("value")).write.text(path)
    rows = t.spark.read.text(path).select(F.explode(F.from_json("value", "map<string, array<struct<line: bigint>>>")).alias("repo", "fs"))
    return rows.select("repo", F.explode("fs").alias("f")).select("repo", "f.line")


@query("SELECT conv_id::VARCHAR AS file, role AS rule, turn::INT AS line FROM conversations")
def src_06_two_shapes(t: Tables) -> DataFrame:
    c = t.conversations.select(C("conv_id").cast("string").alias("file"), C("role").alias("rule"), C("turn").cast("int").alias("line"))
    deep = c.filter("rule = 'user'").groupBy("file", "rule").agg(F.collect_list("line").alias("issues")).groupBy("file").agg(F.collect_list(F.struct("rule", "issues")).alias("detectors"))
    return files.unify_findings(deep, c.filter("rule <> 'user'"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 4")
def src_07_latest_file(t: Tables) -> DataFrame:
    path = files.scratch_path(t.spark, "runs")
    t.nation.withColumn("run", F.concat(F.lit("2026-01-0"), C("n_regionkey").cast("string"))).write.partitionBy("run").json(path)
    return files.latest_file(t.spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path), r"run=[0-9-]+").select("n_nationkey", "n_name")


@query("SELECT c_custkey, c_name FROM customer")
def src_10_table_scan(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name")


@query("SELECT i AS id, md5(i::VARCHAR) AS uuid, i % 10 <> 0 AS subscribed FROM range(1, 1001) r(i)")
def src_13_generate_series(t: Tables) -> DataFrame:
    return t.spark.range(1, 1001).select("id", F.md5(C("id").cast("string")).alias("uuid"), (C("id") % 10 != 0).alias("subscribed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'local' ELSE o_orderstatus END AS schema FROM orders")
def src_14_local_else_remote(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", C("o_orderstatus").alias("schema"))
    local = o.filter("o_orderkey % 3 = 0").withColumn("schema", F.lit("local"))
    return files.local_or_remote(o.select("o_orderkey"), local, o, "o_orderkey", "schema")


@query("SELECT 'region ' || r_name AS section, 'o' || n_regionkey::VARCHAR || '/' || n_name AS repo, n_nationkey::VARCHAR AS stars FROM nation JOIN region ON n_regionkey = r_regionkey")
def parse_01_markdown_corpus(t: Tables) -> DataFrame:
    """A corpus file per region is written as Markdown and parsed back."""
    n = t.nation.join(t.region.select(C("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    row = F.format_string("| [%s](https://example.org/o%d/%s) | %d |", "n_name", "n_regionkey", "n_name", "n_nationkey")
    docs = n.groupBy("r_name").agg(F.concat_ws("\n", F.concat(F.lit("# Corpus\n\n## region "), C("r_name")), F.lit("| repo | stars |\n| --- | --- |"), F.concat_ws("\n", F.array_sort(F.collect_list(row)))).alias("text"))
    return parsers.markdown_corpus(docs, "r_name", "text").select("section", "repo", F.element_at("cells", 2).alias("stars"))


#: Heading, header with its rule, and row of each dialect of corpus files; N, I and S stand for a nation's name, key and stars.
DIALECTS = [
    ("## Domain 1 — Web", "| # | Repository | Lang | URL | Stars | Expected Anti-Patterns |\n|---|---|---|---|---|---|", "| I | N | Py | https://example.org/o/N | S | a, b |"),
    ("## Domain 2 - Web", "| # | Repository | URL | Stars | Domain |\n| --- | --- | --- | --- | --- |", "| I | N | https://example.org/o/N | S | web |"),
    ("## Domain 3 – Web", "| # | Repository | URL | Stars | Expected Patterns |\n|:--|:-:|---|---|--:|", "| I | N | https://example.org/o/N.git | S | a , b"),
    ("## Domain 4: Web", "", "| I | https://example.org/o/N | S |"),
    ("## Domain 5: Web (12 repos)", "| # | Repo | Type | URL | Stars | Notes |\n|-|-|-|-|-|-|", "| I | N | js | https://example.org/o/N | S | one \\| two |"),
    ("## Category 6: Web", "| # | URL |\n|---|---|", "| I | https://example.org/o/N/ |"),
    ("# Web", "| Name | Link | ★ |\n|---|---|---|", "| [N](https://example.org/o/N) | x | S |"),
    ("### Web ###", "", "- [N](https://example.org/o/N) S stars"),
    ("## Web", "some words\n", "* https://example.org/o/N"),
    ("## Web", "| # | Repository | Notes | URL | Stars |\n|---|---|---|---|---|", "| I | N | `a|b` | https://example.org/o/N | S |"),
    ("## Web", "| Stars | Repo |\n|---|---|\n\nno table\n\n| Repo | URL | Stars |\n|---|---|---|", "| N | <https://example.org/o/N> | S |"),
]


@query(
    """SELECT n_nationkey, 'Web' AS section, CASE WHEN d IN (7, 8) THEN 'bullet' ELSE 'table' END AS kind, CASE WHEN d IN (0, 1, 2, 3, 4, 5, 9) THEN n_nationkey::INT END AS index,
      CASE WHEN d IN (3, 5, 7, 8) THEN 'o/' || name ELSE name END AS repo, 'https://example.org/o/' || name AS url, CASE WHEN d IN (0, 1, 2, 4, 6, 9, 10) THEN n_regionkey::VARCHAR END AS stars,
      CASE d WHEN 0 THEN 'Python' WHEN 4 THEN 'js' END AS language, CASE d WHEN 1 THEN 'web' WHEN 4 THEN 'one | two' WHEN 9 THEN '`a|b`' END AS notes, CASE WHEN d IN (0, 2) THEN 'a;b' END AS patterns
    FROM (SELECT *, n_nationkey % 11 AS d, replace(n_name, ' ', '_') AS name FROM nation)"""
)
def parse_01_dialects(t: Tables) -> DataFrame:
    """A corpus file a nation, in eleven dialects."""
    pick = lambda i: F.get(F.array(*[F.lit(d[i]) for d in DIALECTS]), (C("n_nationkey") % 11).cast("int"))
    row = pick(2)
    for letter, value in (("N", F.replace("n_name", F.lit(" "), F.lit("_"))), ("I", C("n_nationkey").cast("string")), ("S", C("n_regionkey").cast("string"))):
        row = F.regexp_replace(row, rf"\b{letter}\b", value)
    docs = t.nation.select("n_nationkey", F.concat_ws("\n", pick(0), F.lit(""), pick(1), row).alias("text"))
    return parsers.corpus_rows(docs, "n_nationkey", "text").select("n_nationkey", "section", "kind", "index", "repo", "url", "stars", "language", "notes", F.array_join("patterns", ";").alias("patterns"))


@query("SELECT min(page_id) AS page_id FROM pages GROUP BY lower(split_part(split_part(url, '?', 1), '#', 1))")
def parse_02_first_spelling(t: Tables) -> DataFrame:
    u = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return parsers.first_spelling(t.pages.select("page_id", u.alias("u")), "u", "page_id").select("page_id")


@query("SELECT n_name AS model, n_nationkey % 2 = 0 AS covered FROM nation")
def parse_03_schema_models(t: Tables) -> DataFrame:
    """A schema text per nation; a foreign key is covered if an index leads with its columns, in any order."""
    index = F.when(C("n_nationkey") % 2 == 0, "  @@index([b, a, c])\n").otherwise("  @@index([c, a, b])\n")
    text = F.concat(F.lit("model "), C("n_name"), F.lit(" {\n  id Int @id\n  a Int\n  b Int? // note\n  rel Other @relation(fields: [a, b], references: [x, y])\n"), index, F.lit("}\n"))
    m = parsers.schema_models(t.nation.select("n_nationkey", text.alias("text")), "n_nationkey", "text")
    key = F.filter("fields", lambda f: F.size(f["relation"]) > 0)[0]["relation"]
    covered = F.exists("indexes", lambda i: F.array_sort(F.slice(i, F.lit(1), F.size(key))) == F.array_sort(key))
    return m.select("model", covered.alias("covered"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'postgresql' ELSE 'mysql' END AS provider, CASE WHEN s_suppkey % 3 = 0 THEN 'prisma' ELSE '' END AS relation_mode FROM supplier")
def parse_05_datasource(t: Tables) -> DataFrame:
    p = F.when(C("s_suppkey") % 2 == 0, "postgresql").otherwise("mysql")
    m = F.when(C("s_suppkey") % 3 == 0, '  relationMode = "prisma"\n').otherwise('  // relationMode = "prisma"\n')
    text = F.concat(F.lit('/* provider = "x" */\ndatasource db {\n  provider = "'), p, F.lit('"\n'), m, F.lit("}\n"))
    return parsers.datasource_settings(t.supplier.select("s_suppkey", text.alias("text")), "s_suppkey", "text")


@query("SELECT s_suppkey, 1 AS line, sha1(s_name) AS commit, s_name AS author, 1700000000 + s_suppkey AS time FROM supplier")
def parse_06_blame(t: Tables) -> DataFrame:
    text = F.concat(F.sha1("s_name"), F.lit(" 7 1 1\nauthor "), C("s_name"), F.lit("\nauthor-time "), (C("s_suppkey") + 1700000000).cast("string"), F.lit("\nsummary x\n\tcode"))
    return parsers.blame_lines(t.supplier.select("s_suppkey", text.alias("text")), "s_suppkey", "text").select("s_suppkey", "line", "commit", "author", "time")


@query("SELECT p_brand, 'model User {' || chr(10) || '  ' || p_brand || chr(10) || '}' AS block FROM (SELECT DISTINCT p_brand FROM part)")
def parse_08_block_text(t: Tables) -> DataFrame:
    text = F.concat(F.lit("model Other {\n  x\n}\nmodel User {\n  "), C("p_brand"), F.lit("\n}\nmodel Last {\n}\n"))
    return parsers.block_from(t.part.select("p_brand").distinct().withColumn("text", text), "p_brand", "text", "User")


TREE = "CASE WHEN n_nationkey % 3 = 0 THEN 'node_modules' WHEN n_nationkey % 3 = 1 THEN 'src' ELSE 'test' END"


def tree(t: Tables) -> str:
    """A folder of a source file a nation, in three folders."""
    path = files.scratch_path(t.spark, "tree")
    t.nation.select(F.expr(TREE).alias("dir"), C("n_nationkey").alias("k"), "n_name").write.partitionBy("dir", "k").text(path)
    return path


@query(f"SELECT n_nationkey, n_name AS text FROM nation WHERE {TREE} <> 'node_modules' AND length(n_name) < 9")
def src_08_source_tree(t: Tables) -> DataFrame:
    """Folders are pruned before they are opened, extensions and sizes before a file is read."""
    found = files.source_tree(t.spark, tree(t), "txt,js", "dir=node_modules,dist", max_bytes=9)
    return found.select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("bigint").alias("n_nationkey"), F.trim(F.col("text"), F.lit("\n")).alias("text"))


@query(f"SELECT n_nationkey, {TREE} AS dir FROM nation WHERE {TREE} IN ('src', 'test') AND n_nationkey NOT IN (4, 5)")
def src_09_glob(t: Tables) -> DataFrame:
    found = files.glob_scan(t.spark, tree(t), "dir={src,test,dist}/**/*.txt", ["**/k=4/*", "dir=test/k=?/*-none.*", "dir=*/k=5/**"])
    return found.select(F.regexp_extract("path", r"k=(\d+)/", 1).cast("bigint").alias("n_nationkey"), F.regexp_extract("path", r"^dir=(\w+)/", 1).alias("dir"))


@query(
    """SELECT n_regionkey AS part, page, (n_regionkey % 2)::BIGINT AS retries, n_nationkey AS item FROM (SELECT *, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) // 2 + 1 AS page FROM nation)
    WHERE NOT (n_regionkey = 3 AND page >= 2)"""
)
def src_11_recorded_pages(t: Tables) -> DataFrame:
    """Two nations a page; odd regions refuse the first attempt, and the second page of region 3 never comes."""
    page = F.floor((F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1) / 2) + 1
    bodies = t.nation.withColumn("page", page).groupBy(C("n_regionkey").alias("part"), "page").agg(F.to_json(F.sort_array(F.collect_list("n_nationkey"))).alias("body"))
    tries = bodies.select("*", F.explode(F.when(C("part") % 2 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("attempt"))
    refused = (C("part") % 2 == 1) & (C("attempt") == 1) | (C("part") == 3) & (C("page") == 2)
    responses = tries.withColumn("status", F.when(refused, 429).otherwise(200)).withColumn("body", F.when(~refused, C("body")))
    return files.replayed_pages(responses, "bigint").select("part", "page", "retries", "item")


@query("SELECT p_partkey, p_size, true AS retries_as_recorded FROM part WHERE p_size < 64")
def src_11_size_ranges(t: Tables) -> DataFrame:
    """A service that shows an eighth of its items at most of one range of sizes, by pages of a third of that; ranges are halved until they fit. Pages of ranges that begin with a multiple of seven are refused at first."""
    n = t.part.count()
    cap = max(30, n // 8)
    page_size = max(1, cap // 3)
    path = files.scratch_path(t.spark, "answers")
    width = F.explode(F.array(*[F.lit(64 >> k) for k in range(7)])).alias("width")
    items = t.part.select("p_partkey", C("p_size").cast("int").alias("size"), width).withColumn("low", F.floor(C("size") / C("width")) * C("width"))
    w = W.partitionBy("low", "width").orderBy("p_partkey")
    paged = items.select("*", (F.floor((F.row_number().over(w) - 1) / page_size) + 1).alias("page"), F.count(F.lit(1)).over(W.partitionBy("low", "width")).alias("total"))
    shown = paged.filter(C("page") <= 1 + F.floor(F.lit((cap - 1) / page_size)))
    good = shown.groupBy("low", "width", "page", "total").agg(F.sort_array(F.collect_list(F.struct(C("p_partkey").alias("id"), "size"))).alias("items"))
    refused = C("low") % 7 == 0
    answer = lambda attempt, status, total, items_: F.to_json(F.struct("page", attempt.alias("attempt"), F.lit(status).alias("status"), total.alias("total"), items_.alias("items")))
    lines = good.select("low", (C("low") + C("width") - 1).alias("high"), F.explode(F.array_compact(F.array(F.when(refused, answer(F.lit(1), 429, F.lit(None).cast("bigint"), F.lit(None).cast(good.schema["items"].dataType))), answer(F.when(refused, 2).otherwise(1), 200, C("total"), C("items"))))).alias("value"))
    lines.repartition("low", "high").write.partitionBy("low", "high").text(path)
    got = files.paged_service(t.spark, path, 63, cap, page_size, wait=0)
    item = F.from_json("item", "id bigint, size int")
    return got.select(item.alias("i"), (C("retries") == (C("low") % 7 == 0).cast("int")).alias("retries_as_recorded")).select(C("i.id").alias("p_partkey"), C("i.size").alias("p_size"), "retries_as_recorded")


@query("SELECT s_suppkey, sha1(s_name) AS commit, (1704067200 + s_suppkey * 86400 + CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE -7200 END)::BIGINT AS committed FROM supplier")
def src_12_log_dates(t: Tables) -> DataFrame:
    """Commit dates of a log, half of them without a zone; an entry with an unreadable date in between."""
    day = F.date_format(F.timestamp_seconds(F.lit(1704067200) + C("s_suppkey") * 86400), "EEE MMM d HH:mm:ss yyyy")
    zone = F.when(C("s_suppkey") % 2 == 0, "").otherwise(" +0200")
    text = F.concat(F.lit("commit "), F.sha1("s_name"), F.lit("\nAuthor: a <a@example.org>\nDate:   "), day, zone, F.lit("\n\n    commit things\n"), F.lit(f"commit {'0' * 40}\nDate:   unknown\n"))
    return parsers.log_dates(t.supplier.select("s_suppkey", text.alias("text")), "s_suppkey", "text").filter("committed is not null")


GRAPH = """SELECT o_custkey AS graph, n AS commit, unnest(CASE WHEN n = 1 THEN [] WHEN n % 5 = 0 THEN [n - 1, n - 3] WHEN n % 7 = 3 THEN [n - 2] ELSE [n - 1] END) AS parent FROM
  (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"""


def graph(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A customer's orders as a history: each follows the one before; every fifth merges the third before, and some leave out the one before. Edges, heads (the last ones), times."""
    n = t.orders.select(C("o_custkey").alias("graph"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint").alias("commit"), C("o_orderdate").alias("time"))
    parents = F.when(C("commit") == 1, F.array().cast("array<bigint>")).when(C("commit") % 5 == 0, F.array(C("commit") - 1, C("commit") - 3)).when(C("commit") % 7 == 3, F.array(C("commit") - 2)).otherwise(F.array(C("commit") - 1))
    edges = n.select("graph", "commit", F.posexplode(parents).alias("k", "parent")).select("graph", "commit", "parent", (C("k") == 0).alias("first"))
    return edges, n.groupBy("graph").agg(F.max("commit").alias("commit")), n


HEADS = "SELECT o_custkey AS graph, count(*) AS commit FROM orders GROUP BY 1"


@query(f"WITH RECURSIVE e AS ({GRAPH}), r AS ({HEADS} UNION SELECT r.graph, e.parent FROM r JOIN e ON r.graph = e.graph AND r.commit = e.commit) SELECT graph, commit FROM r")
def src_12_reachable(t: Tables) -> DataFrame:
    """The commits that each head reaches."""
    edges, heads, _ = graph(t)
    return reachable(edges, heads)


CHAIN = f"""e AS (SELECT graph, commit, max(parent) AS parent FROM ({GRAPH}) GROUP BY 1, 2),
  r AS (SELECT graph, commit, 0::BIGINT AS distance FROM ({HEADS}) UNION ALL SELECT r.graph, e.parent, distance + 1 FROM r JOIN e ON r.graph = e.graph AND r.commit = e.commit)"""


@query(f"WITH RECURSIVE {CHAIN} SELECT graph, commit, distance FROM r")
def src_12_first_parents(t: Tables) -> DataFrame:
    edges, heads, _ = graph(t)
    return first_parents(edges, heads)


@query(
    f"""WITH RECURSIVE {CHAIN}, o AS (SELECT o_custkey AS graph, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS commit, o_orderdate AS time FROM orders),
      p AS (SELECT r.*, time FROM r JOIN o ON r.graph = o.graph AND r.commit = o.commit)
      SELECT graph, arg_min(commit, distance) FILTER (time <= DATE '1996-06-30') AS commit, (count(*) FILTER (time > DATE '1996-06-30'))::BIGINT AS behind FROM p GROUP BY graph HAVING count(*) FILTER (time <= DATE '1996-06-30') > 0"""
)
def src_12_last_before(t: Tables) -> DataFrame:
    """The commit that a cutoff date pins on the chain of first parents, and how many came after."""
    edges, heads, times = graph(t)
    return last_before(first_parents(edges, heads), times, F.lit("1996-06-30").cast("date")).select("graph", "commit", "behind")


@query("SELECT p_partkey::VARCHAR AS p_partkey, CASE WHEN p_size < 10 THEN '' ELSE p_size::VARCHAR END AS p_size, p_brand FROM part")
def snk_01_tsv(t: Tables) -> DataFrame:
    """Columns in a fixed order, null as an empty cell."""
    path = files.scratch_path(t.spark, "tsv")
    files.write_tsv(t.part.select("p_partkey", F.when(C("p_size") >= 10, C("p_size")).alias("p_size"), "p_brand"), path)
    return files.read_tsv(t.spark, path, ["p_partkey", "p_size", "p_brand"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS priority FROM orders")
def snk_04_json_array(t: Tables) -> DataFrame:
    """JSON arrays written record after record, and read back as such; files without records are empty arrays."""
    path = files.scratch_path(t.spark, "json")
    rows = t.orders.select("o_orderkey", F.when(C("o_orderstatus") != "F", C("o_orderpriority")).alias("priority"))
    files.write_json_arrays(rows.repartition(4).unionByName(rows.limit(0)), path)
    return files.read_json_arrays(t.spark, path, "o_orderkey bigint, priority string")


@query(
    """SELECT n_nationkey, 'people' AS "table", 'CREATE TYPE "Role" AS ENUM (''ADMIN'', ''member'');' || chr(10) || 'CREATE TABLE "people" ("id" ' || CASE WHEN n_nationkey % 2 = 0 THEN 'uuid' ELSE 'integer' END
      || ' NOT NULL PRIMARY KEY, "full_name" text, "role" "Role" NOT NULL);' AS ddl FROM nation"""
)
def parse_04_typed_ddl(t: Tables) -> DataFrame:
    """Scalar and enum columns with their mapped names; lists and relations are no columns."""
    key = F.when(C("n_nationkey") % 2 == 0, "String @id @db.Uuid").otherwise("Int @id")
    text = F.concat(
        F.lit('enum Role {\n  ADMIN\n  MEMBER @map("member") // lower\n}\nenum Unused {\n  X\n}\nmodel Other {\n  id Int @id\n}\nmodel Person {\n  id '), key,
        F.lit('\n  name String? @map("full_name")\n  role Role // as above\n  tags String[]\n  other Other @relation(fields: [id], references: [id])\n  @@map("people")\n}\n'),
    )
    return parsers.typed_tables(t.nation.select("n_nationkey", text.alias("text")), "n_nationkey", "text", "Person").select("n_nationkey", "table", "ddl")


@query("SELECT doc_id::VARCHAR AS doc_id, regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') AS text FROM documents")
def snk_02_clean_tsv(t: Tables) -> DataFrame:
    path = files.scratch_path(t.spark, "tsv")
    files.write_tsv(t.documents.select("doc_id", "text"), path, clean=True)
    return files.read_tsv(t.spark, path, ["doc_id", "text"])


@query("SELECT page_id, url FROM pages")
def snk_03_json(t: Tables) -> DataFrame:
    path = files.scratch_path(t.spark, "json")
    t.pages.select("page_id", "url").write.json(path)
    return t.spark.read.schema("page_id long, url string").json(path)


@query("SELECT conv_id, turn, md5(text) AS text FROM conversations")
def snk_05_csv(t: Tables) -> DataFrame:
    path = files.scratch_path(t.spark, "csv")
    files.write_csv(t.conversations.select("conv_id", "turn", F.concat(F.lit('"'), C("text")).alias("text")), path)
    back = t.spark.read.schema("conv_id long, turn long, text string").csv(path, header=True, escape='"', multiLine=True)
    return back.select("conv_id", "turn", F.md5(F.expr("substring(text, 2)")).alias("text"))


@query("SELECT o_orderkey FROM orders")
def snk_07_append_and_resume(t: Tables) -> DataFrame:
    path = files.scratch_path(t.spark, "resume")
    o = t.orders.select("o_orderkey")
    files.append_missing(o.filter("o_orderkey % 2 = 0"), path, "o_orderkey")
    files.append_missing(o, path, "o_orderkey")
    return t.spark.read.schema(o.schema).parquet(path)


@query("SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS \"O\" FROM orders")
def snk_09_manifest(t: Tables) -> DataFrame:
    return files.manifest(t.orders, C("o_orderstatus"), ["F", "O"])


@query("SELECT i AS id, CASE i % 10 WHEN 6 THEN 'inactive' WHEN 7 THEN 'inactive' WHEN 8 THEN 'inactive' WHEN 9 THEN 'suspended' ELSE 'active' END AS status FROM range(0, 5000) r(i)")
def gen_02_cyclic_status(t: Tables) -> DataFrame:
    cycle = F.array(*[F.lit(s) for s in ["active"] * 6 + ["inactive"] * 3 + ["suspended"]])
    return t.spark.range(5000).select("id", F.get(cycle, (C("id") % 10).cast("int")).alias("status"))


@query("SELECT i AS id, repeat('a', i) || '!' AS input FROM range(1, 41) r(i)")
def gen_04_malicious_inputs(t: Tables) -> DataFrame:
    return t.spark.range(1, 41).select("id", F.concat(F.repeat(F.lit("a"), C("id").cast("int")), F.lit("!")).alias("input"))


@query("SELECT n_nationkey AS id, n_name AS rule FROM nation")
def src_03_json_array(t: Tables) -> DataFrame:
    """Files that each hold one JSON array of records (a region's nations), read with a given schema."""
    path = files.scratch_path(t.spark, "arrays")
    rows = F.to_json(F.collect_list(F.struct(C("n_nationkey").alias("id"), C("n_name").alias("rule"))))
    t.nation.groupBy(C("n_regionkey").alias("file")).agg(rows.alias("value")).write.partitionBy("file").text(path)
    return files.read_json_arrays(t.spark, path, "id long, rule string").select("id", "rule")


@query("SELECT i AS id, 'user' || i::VARCHAR || '@example.org' AS email, CASE WHEN i % 7 = 0 THEN NULL ELSE 'bio ' || i::VARCHAR END AS bio, '{\"n\":' || i::VARCHAR || '}' AS meta, strftime(TIMESTAMP '2024-01-01' + to_days((i % 365)::INT), '%Y-%m-%d') AS day FROM range(1, 2001) r(i)")
def gen_03_wide_users(t: Tables) -> DataFrame:
    """Users from a series: nullable text, JSON, dates by interval."""
    i = C("id").cast("string")
    day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((C("id") % 365).cast("int"))
    return t.spark.range(1, 2001).select(
        "id", F.concat(F.lit("user"), i, F.lit("@example.org")).alias("email"), F.when(C("id") % 7 != 0, F.concat(F.lit("bio "), i)).alias("bio"),
        F.to_json(F.struct(C("id").alias("n"))).alias("meta"), F.date_format(day, "yyyy-MM-dd").alias("day"),
    )


DRAWS = mulberry_sql("42", "SELECT unnest(range(1, 3001)) AS n", "n", "n")


@query(
    f"""SELECT (n - 1) // 3 AS id, floor(max(draw) FILTER (WHERE n % 3 = 1) * 1000)::INT AS value, max(draw) FILTER (WHERE n % 3 = 2) < 0.5 AS active, floor(max(draw) FILTER (WHERE n % 3 = 0) * 256)::INT AS cell
    FROM ({DRAWS}) GROUP BY 1"""
)
def gen_01_seeded_inputs(t: Tables) -> DataFrame:
    """Items (id, value, active) and a matrix cell per id from one seeded stream; tests hold the stream."""
    from ..functions.prng import mulberry32

    n = 1000
    draws = mulberry32(42, 3 * n).reshape(n, 3)
    rows = [(k, int(a * 1000), bool(b < 0.5), int(c * 256)) for k, (a, b, c) in enumerate(draws.tolist())]
    return t.spark.createDataFrame(rows, "id long, value int, active boolean, cell int")


@query("SELECT '| ' || event_type || ' | ' || n::VARCHAR || ' |' AS line FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def snk_06_markdown(t: Tables) -> DataFrame:
    """A small summary rendered as a Markdown table; its body lines."""
    n = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("event_type")
    body = files.markdown_table(n).split("\n")[2:]
    return t.spark.createDataFrame([(x,) for x in body], "line string")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def snk_08_partitioned_output(t: Tables) -> DataFrame:
    """Output written by partition; a rerun overwrites only the partitions it holds, so a scan can resume."""
    path = files.scratch_path(t.spark, "partitioned")
    s = t.supplier.join(t.nation, C("s_nationkey") == C("n_nationkey")).select("s_suppkey", "n_name", "n_regionkey")
    for part in (s.filter("n_regionkey < 2"), s.filter("n_regionkey >= 1")):
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("n_regionkey").parquet(path)
    return t.spark.read.schema("s_suppkey long, n_name string, n_regionkey int").parquet(path).select("s_suppkey", "n_name")


@query("SELECT s_suppkey, length(s_name)::INT AS n FROM supplier")
def snk_08_resumed_scan(t: Tables) -> DataFrame:
    """A scan of files that breaks in its second batch and is run again: each file is scanned once."""
    path, out, progress = (files.scratch_path(t.spark, label) for label in ("scanned", "results", "progress"))
    t.supplier.select(C("s_suppkey") % 7, F.to_json(F.struct("s_suppkey", "s_name"))).toDF("part", "value").repartition("part").write.partitionBy("part").text(path)
    rows = lambda df: df.select(F.explode(F.split("value", "\n")).alias("v")).filter("v <> ''").select(F.from_json("v", "s_suppkey bigint, s_name string").alias("r")).select("r.s_suppkey", F.length("r.s_name").alias("n"))
    calls = []

    def breaks(df: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 2:
            raise OSError("stopped")
        return rows(df)

    try:
        files.resumable_scan(t.spark, path, out, progress, breaks, files_at_once=2)
    except Exception as e:  # the stream's failure
        if "stopped" not in str(e):
            raise
    return files.resumable_scan(t.spark, path, out, progress, rows, files_at_once=2)


@query("SELECT count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM orders")
def snk_10_batched_insert(t: Tables) -> DataFrame:
    """Writes in files of at most 1,000 records."""
    path = files.scratch_path(t.spark, "batched")
    t.orders.select("o_orderkey").write.option("maxRecordsPerFile", 1000).parquet(path)
    return t.spark.read.schema("o_orderkey long").parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size::VARCHAR || ' B' ELSE printf('%.1f KB', floor(p_size * 10 / 10.0::DOUBLE + 0.5) / 10) END AS label FROM part")
def udf_02_metric_labels(t: Tables) -> DataFrame:
    """Formatters looked up by metric."""
    kb = F.format_string("%.1f KB", F.floor(C("p_size") * 10 / F.lit(10.0) + 0.5) / 10)
    formats = {"small": F.concat(C("p_size").cast("string"), F.lit(" B")), "large": kb}
    return t.part.select("p_partkey", F.when(C("p_size") < 10, formats["small"]).otherwise(formats["large"]).alias("label"))


@query()
def ctl_02_plan_node(t: Tables) -> DataFrame:
    """The first operator of a plan, by query."""
    plans = {"lookup": t.customer.filter("c_custkey = 42"), "top": t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20), "join": t.orders.join(t.customer, C("o_custkey") == C("c_custkey"))}
    first = lambda d: d._jdf.queryExecution().sparkPlan().nodeName()
    return t.spark.createDataFrame([(k, first(d)) for k, d in plans.items()], "query string, node string")
