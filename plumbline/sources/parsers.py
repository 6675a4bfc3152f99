"""Parsers that turn text into rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line with its 1-based number."""
    return docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("__p", "line")).select(key, (F.col("__p") + 1).alias("no"), "line")


def markdown_corpus(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of Markdown tables that link a repository, with the heading above them: section, repo, url and the row's cells."""
    rows = lines_of(docs, key, text)
    heading = F.nullif(F.regexp_extract("line", r"^#{1,6}\s+(.*?)\s*$", 1), F.lit(""))
    w = W.partitionBy(key).orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    carried = rows.withColumn("section", F.last(heading, ignorenulls=True).over(w)).filter(F.col("line").rlike(r"^\s*\|"))
    link = r"https?://[^\s|)\]]+/([^/\s|)\]]+/[^/\s|)\]]+?)(?:\.git)?/?[\s|)\]]"
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    found = carried.select(key, "no", "section", F.regexp_extract("line", link, 1).alias("repo"), F.regexp_extract("line", r"(https?://[^\s|)\]]+)", 1).alias("url"), cells.alias("cells"))
    return found.filter("repo <> ''")


#: A heading's words without a number of the section or of what it lists.
SECTION = r"^#{1,6}\s+(?:(?:Domain|Category)\s+\d+\s*(?:[—–:：-]\s*)?)?(.*?)\s*(?:\(\d+ repos\))?\s*#*$"
#: A cell up to its pipe: escapes and code spans hide pipes.
CELL = r"((?:\\.|`[^`]*`|[^|\\])*)(?:\||$)"
LINK = r"https?://[^\s|)\]>]+"
#: Column names of corpus tables, by what they hold.
COLUMNS = {
    "repo": ("repository", "repo", "name", "project"), "url": ("url", "link"), "stars": ("stars", "★"), "language": ("lang", "language", "type"), "notes": ("notes", "domain", "reason"),
    "patterns": ("expected anti-patterns", "expected patterns", "patterns", "expected"),
}


def corpus_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every listed repository of Markdown corpora, whatever their dialect: key, no, section, kind, index, repo, url, stars, language, notes, patterns.

    Rows of tables and bullets that hold a link count; kind is `table` or `bullet`. Columns are found
    by the header; without a header, or without a column of that name, the repository comes from the link,
    the index from a first cell that is a number, and other columns are null. Pipes that are escaped or within code
    spans divide no cells. Sections are carried down from headings, numbers of sections and of their entries left out.
    """
    w = W.partitionBy(key).orderBy("no")
    rows = lines_of(docs, key, text)
    heading = F.when(F.col("line").rlike(r"^#{1,6}\s"), F.regexp_extract("line", SECTION, 1))
    is_table, is_rule = F.col("line").rlike(r"^\s*\|"), F.col("line").rlike(r"^\s*\|[\s:|-]*-[\s:|-]*$")
    inner = F.regexp_replace(F.col("line"), r"^\s*\||\|?\s*$", "")
    cells = F.transform(F.regexp_extract_all(inner, F.lit(CELL), 1), lambda c: F.trim(F.regexp_replace(c, r"\\\|", "|")))
    cells = F.slice(cells, 1, F.greatest(F.lit(1), F.size(cells) - 1))  # the match behind the last cell
    marked = rows.withColumns({
        "section": F.last(heading, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "is_table": is_table, "is_rule": is_rule, "cells": F.when(is_table, cells),
        "is_header": is_table & F.coalesce(F.lead(is_rule).over(w), F.lit(False)), "block": F.count_if(~is_table).over(w.rowsBetween(W.unboundedPreceding, 0)),
    })
    names = F.transform("cells", lambda c: F.lower(F.trim(c, F.lit("*` "))))
    header = F.last(F.when(F.col("is_header"), F.struct("block", names.alias("names"))), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    found = marked.withColumn("header", header).withColumn("names", F.when(F.col("header.block") == F.col("block"), F.col("header.names")))
    url = F.nullif(F.regexp_extract("line", LINK, 0), F.lit(""))
    listed = found.filter((F.col("is_table") & ~F.col("is_rule") & ~F.col("is_header") | F.col("line").rlike(r"^\s*[-*+]\s")) & url.isNotNull())

    def column(what: str):
        place = F.coalesce(*[F.nullif(F.array_position("names", n), F.lit(0)) for n in COLUMNS[what]])
        return F.nullif(F.get("cells", (place - 1).cast("int")), F.lit(""))

    clean = F.regexp_replace(url, r"(\.git)?/?$", "")
    of_link = F.nullif(F.regexp_extract(clean, r"^https?://[^/]+/([^/]+/[^/#?]+)", 1), F.lit(""))
    # A name that is itself a link gives its words.
    named = F.regexp_replace(column("repo"), r"^\[([^\]]*)\]\(.*\)$", "$1")
    language = F.when(column("language") == "Py", "Python").otherwise(column("language"))
    return listed.select(
        key, "no", "section", F.when(F.col("is_table"), "table").otherwise("bullet").alias("kind"), F.get("cells", F.lit(0)).try_cast("int").alias("index"),
        F.coalesce(F.when(~named.rlike(LINK), named), of_link).alias("repo"), clean.alias("url"), column("stars").alias("stars"), language.alias("language"), column("notes").alias("notes"),
        F.filter(F.transform(F.split(column("patterns"), ","), lambda p: F.trim(p)), lambda p: p != "").alias("patterns"),
    )


def first_spelling(urls: DataFrame, url: str, order: str) -> DataFrame:
    """One row per address regardless of case; the first spelling stays."""
    return urls.groupBy(F.lower(url).alias("__k")).agg(F.min_by(F.struct(*urls.columns), F.col(order)).alias("__r")).select("__r.*")


MODEL = re.compile(r"^\s*model\s+(\w+)\s*\{")
FIELD = re.compile(r"^\s*(\w+)\s+(\w+)(\[\])?(\?)?(.*)$")
LISTED = re.compile(r"^\s*@@(index|unique|id)\s*\(\s*(?:fields:\s*)?\[([^\]]*)\]")
MODEL_SCHEMA = (
    "model string, line int, fields array<struct<name: string, type: string, list: boolean, optional: boolean, indexed: boolean, relation: array<string>>>, indexes array<array<string>>"
)


def parse_models(text: str) -> list[tuple]:
    """(model, line, fields, indexes) of each model block; an index is the ordered list of its columns."""
    out, name, at, fields, indexes = [], None, 0, [], []
    for no, raw in enumerate((text or "").splitlines(), 1):
        line = raw.split("//")[0]
        if name is None:
            if m := MODEL.match(line):
                name, at, fields, indexes = m[1], no, [], []
        elif line.strip().startswith("}"):
            out.append((name, at, fields, indexes))
            name = None
        elif m := LISTED.match(line):
            indexes.append([re.split(r"[(\s]", c.strip())[0] for c in m[2].split(",") if c.strip()])
        elif (m := FIELD.match(line)) and not line.strip().startswith("@@"):
            relation = re.search(r"@relation\([^)]*fields:\s*\[([^\]]*)\]", m[5])
            single = bool(re.search(r"@(id|unique)\b", m[5]))
            fields.append((m[1], m[2], bool(m[3]), bool(m[4]), single, [c.strip() for c in relation[1].split(",")] if relation else []))
            if single:
                indexes.append([m[1]])
    return out


def schema_models(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per model block of every schema text."""
    parse = F.udf(parse_models, f"array<struct<{', '.join(c for c in MODEL_SCHEMA.split(', ', 2)[:2])}, {MODEL_SCHEMA.split(', ', 2)[2]}>>".replace("model string", "model: string").replace("line int", "line: int").replace("fields array", "fields: array").replace("indexes array", "indexes: array"))
    return docs.select(key, F.explode(parse(text)).alias("m")).select(key, "m.*")


#: SQL types of schema scalar types.
SCALARS = {
    "String": T.StringType(), "Int": T.IntegerType(), "BigInt": T.LongType(), "Float": T.DoubleType(), "Decimal": T.DecimalType(38, 18), "Boolean": T.BooleanType(),
    "DateTime": T.TimestampType(), "Json": T.StringType(), "Bytes": T.BinaryType(),
}


def model_schema(text: str, model: str) -> T.StructType:
    """A model block as a StructType: enums are strings, relations are no columns."""
    enums = set(re.findall(r"^\s*enum\s+(\w+)\s*\{", text, re.M))
    block = next(m for m in parse_models(text) if m[0] == model)
    kind = lambda t: T.StringType() if t in enums else SCALARS.get(t)
    return T.StructType([T.StructField(n, T.ArrayType(kind(t)) if many else kind(t), bool(opt)) for n, t, many, opt, *_ in block[2] if kind(t)])


#: Column types of schema scalar types in DDL.
DDL_TYPES = {"Int": "integer", "String": "text", "Boolean": "boolean", "DateTime": "timestamp(3)", "Json": "jsonb", "BigInt": "bigint", "Float": "double precision"}
MAPPED = re.compile(r"""@map\((?:name:\s*)?"([^"]+)"\)""")
TYPED_SCHEMA = "table: string, columns: array<struct<name: string, type: string, nullable: boolean, primary: boolean>>, enums: array<struct<name: string, labels: array<string>>>"


def parse_enums(text: str) -> dict[str, list[str]]:
    """Labels of each enum block, by their mapped names."""
    out: dict[str, list[str]] = {}
    labels = None
    for raw in text.splitlines():
        line = raw.split("//")[0].strip()
        if m := re.match(r"enum\s+(\w+)\s*\{$", line):
            labels = out.setdefault(m[1], [])
        elif line.startswith("}"):
            labels = None
        elif labels is not None and line and not line.startswith("@@"):
            mapped = MAPPED.search(line)
            labels.append(mapped[1] if mapped else line.split()[0])
    return out


def typed_table(text: str | None, model: str) -> tuple | None:
    """A model as a typed table: its mapped name, scalar and enum columns (lists and relations are none), and the enums they use."""
    enums, inside, table, columns = parse_enums(text or ""), False, model, []
    for raw in (text or "").splitlines():
        line = raw.split("//")[0].strip()
        if re.match(rf"model\s+{re.escape(model)}\s*\{{$", line):
            inside = True
        elif inside and line.startswith("}"):
            used = [(name, enums[name]) for name in dict.fromkeys(kind for *_, kind, _ in columns if kind in enums)]
            quoted = [(n, f'"{kind}"' if kind in enums else kind, null, primary) for n, null, primary, kind, _ in columns]
            return table, quoted, used
        elif inside and line.startswith("@@map"):
            table = re.search(r'"([^"]+)"', line)[1]
        elif inside and not line.startswith("@@") and (m := FIELD.match(line)) and not m[3]:
            kind = m[2] if m[2] in enums else "uuid" if "@db.Uuid" in m[5] and m[2] in DDL_TYPES else DDL_TYPES.get(m[2])
            if kind:
                mapped = MAPPED.search(m[5])
                columns.append((mapped[1] if mapped else m[1], bool(m[4]), bool(re.search(r"@id\b", m[5])), kind, None))
    return None


def typed_tables(docs: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """key, table, columns, enums and the DDL of a model of every schema text; texts without the model have no row."""
    parse = F.udf(lambda t: typed_table(t, model), f"struct<{TYPED_SCHEMA}>")
    found = docs.select(key, parse(text).alias("t")).filter("t is not null").select(key, "t.*")
    column = lambda c: F.concat(F.lit('"'), c["name"], F.lit('" '), c["type"], F.when(c["nullable"], "").otherwise(" NOT NULL"), F.when(c["primary"], " PRIMARY KEY").otherwise(""))
    kinds = lambda e: F.concat(F.lit('CREATE TYPE "'), e["name"], F.lit("\" AS ENUM ('"), F.array_join(e["labels"], "', '"), F.lit("');"))
    create = F.concat(F.lit('CREATE TABLE "'), F.col("table"), F.lit('" ('), F.array_join(F.transform("columns", column), ", "), F.lit(");"))
    return found.withColumn("ddl", F.array_join(F.concat(F.transform("enums", kinds), F.array(create)), "\n"))


def log_dates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """commit and committed (UTC seconds) of every entry of a git log text; dates with or without a zone."""
    entry = F.expr(rf"regexp_extract_all(`{text}`, '(?m)^commit [0-9a-f]{{40}}[^\n]*(?:\n(?!commit )[^\n]*)*', 0)")
    rows = docs.select(key, F.explode(entry).alias("e"))
    date = F.regexp_extract("e", r"(?m)^Date:\s+\w{3} (\w{3} \d{1,2} \d\d:\d\d:\d\d \d{4}(?: [+-]\d{4})?)", 1)
    zoned = F.when(date.rlike(r"[+-]\d{4}$"), date).otherwise(F.concat(date, F.lit(" +0000")))
    return rows.select(key, F.regexp_extract("e", r"^commit ([0-9a-f]{40})", 1).alias("commit"), F.unix_timestamp(F.try_to_timestamp(zoned, F.lit("MMM d HH:mm:ss yyyy Z"))).alias("committed"))


def datasource_settings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """provider and relationMode of a datasource block, comments stripped first."""
    clean = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    block = F.regexp_extract(clean, r"(?s)datasource\s+\w+\s*\{(.*?)\}", 1)
    pick = lambda name: F.regexp_extract(block, rf'{name}\s*=\s*"([^"]*)"', 1)
    return docs.select(key, pick("provider").alias("provider"), pick("relationMode").alias("relation_mode"))


BLAME_SCHEMA = "array<struct<line: int, commit: string, author: string, time: bigint, summary: string>>"


def parse_blame(text: str) -> list[tuple]:
    """One row per line of a porcelain blame: final line number, commit, author, author time, summary."""
    out, head, values = [], None, {}
    for line in (text or "").split("\n"):
        if m := re.match(r"^([0-9a-f]{40}) \d+ (\d+)", line):
            head, values = (m[1], int(m[2])), {}
        elif line.startswith("\t") and head:
            out.append((head[1], head[0], values.get("author"), int(values.get("author-time", 0)), values.get("summary")))
            head = None
        elif head and " " in line:
            k, v = line.split(" ", 1)
            values[k] = v
    return out


def blame_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.explode(F.udf(parse_blame, BLAME_SCHEMA)(text)).alias("b")).select(key, "b.*")


def block_from(docs: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """The text of a named model block up to its closing brace."""
    return docs.select(key, F.regexp_extract(text, rf"(?s)(model\s+{name}\s*\{{.*?\n\}})", 1).alias("block"))
